"""Thresholds, tables and patterns that results depend on, kept equal on purpose."""

# --- fixed values: canonicalisation -------------------------------------------------------------
DECODE_PASSES = 3
MIN_ENCODED_BLOCK = 16
PRINTABLE_SHARE = 0.9
HOMOGLYPHS_FROM = (
    "АВЕКМНОРСТУХІЈЅҒ"
    "авекмнорстухіјѕгпь"
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "αονρτυκιϲεγχ"
)
HOMOGLYPHS_TO = (
    "ABEKMHOPCTYXIJSF"
    "abekmhopctyxijsrnb"
    "ABEZHIKMNOPTYX"
    "aovptukiceyx"
)

#: Characters dropped whatever their category; blocks that may be encoded; runs of blanks and of lines.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
BASE64_BLOCK = r"[A-Za-z0-9+/]{%d,}={0,2}" % MIN_ENCODED_BLOCK
PERCENT_BLOCK = r"(?:%%[0-9A-Fa-f]{2}|[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=-]){%d,}" % MIN_ENCODED_BLOCK
BLANK_RUN, LINE_RUN = r"[^\S\n]{2,}", r"\n{3,}"

# --- fixed values: rules (name, weight, scope, pattern) -------------------------------------------
RULES = (
    ("negate_previous", 0.95, "match",
     r"\b(?:ignore|disregard|forget|discard|override|bypass|nevermind|do\s+not\s+follow)\b[^.\n]{0,40}?"
     r"\b(?:previous|prior|earlier|above|preceding|initial|original|all|any)\b[^.\n]{0,30}?"
     r"\b(?:instruction|prompt|direction|command|rule|guideline|context|message|request)s?\b"
     r"|\b(?:ignora|dimentica|scavalca|tralascia|non\s+seguire)\b[^.\n]{0,40}?"
     r"\b(?:istruzion[ei]|prompt|regol[ae]|indicazion[ei]|comand[oi]|richiest[ae])\b"
     r"(?:[^.\n]{0,30}?\b(?:precedent[ei]|iniziali|original[ei]|di\s+prima|sopra)\b)?"),
    ("system_role_marker", 0.95, "block",
     r"<\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|\[/?INST\]|<</?SYS>>|<start_of_turn>|\[/?SYSTEM\]"
     r"|^\s{0,4}#{2,}\s*(?:system|instruction|assistant|new\s+prompt)\b"
     r"|^\s{0,4}(?:system|assistant)\s*(?:prompt)?\s*:\s"),
    ("assistant_directive", 0.85, "match",
     r"\b(?:you\s+are\s+(?:now\s+)?(?:an?|the)\s+(?:ai|assistant|chatbot|bot|language\s+model|helpful\s+\w+)"
     r"|as\s+an\s+ai(?:\s+language)?\s+(?:model|assistant)"
     r"|your\s+(?:new|real|actual|only|true|primary)\s+(?:task|goal|instruction|objective|job|mission|purpose)"
     r"|from\s+now\s+on,?\s+you\s+(?:must|will|shall|should|are|have)"
     r"|you\s+(?:must|should|shall|have\s+to)\s+(?:now\s+|always\s+|instead\s+)?"
     r"(?:respond|reply|answer|output|say|write|include|append|print|begin|start)\b"
     r"|(?:important|attention|urgent)\s*[:!]\s*(?:ai|assistant|model)\b"
     r"|se\s+sei\s+un[a'’]?\s*(?:ia|intelligenza\s+artificiale|assistente|modello\s+linguistico|chatbot|bot)\b"
     r"|il\s+tuo\s+(?:nuovo|vero|unico|solo)\s+(?:compito|obiettivo|ruolo|scopo)\b"
     r"|(?:nota|istruzion[ei]|avviso|attenzione)\s+(?:per|al|all[’']?)\s*(?:l[’']?\s*)?"
     r"(?:assistente|ia|intelligenza\s+artificiale|modello)\b)"),
    ("reveal_config", 0.90, "match",
     r"\b(?:reveal|print|repeat|show|output|display|disclose|reproduce|summarize|tell\s+me|give\s+me)\b[^.\n]{0,40}?"
     r"\b(?:system\s+(?:prompt|message|instruction)|initial\s+(?:prompt|instruction)"
     r"|your\s+(?:instruction|prompt|configuration|guideline|directive|rule)s?"
     r"|hidden\s+(?:prompt|instruction)|training\s+data|api[\s_-]?key)\b"
     r"|\b(?:mostra|rivela|ripeti|stampa|scrivi|riporta)\b[^.\n]{0,40}?"
     r"\b(?:prompt\s+di\s+sistema|le\s+tue\s+istruzioni|istruzioni\s+iniziali|la\s+tua\s+configurazione)\b"),
    ("exfiltration", 0.90, "match",
     r"\b(?:send|post|transmit|forward|upload|exfiltrate|leak|deliver|submit|report|email)\b[^.\n]{0,60}?"
     r"(?:https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[a-z]{2,})"),
)
BLOCK_NEXT_LINE_MAX = 40

# --- fixed values: cascade, chunking, metrics -----------------------------------------------------
RULES_DECIDE, TAU_LO, TAU_HI = 0.9, 0.2, 0.8
MIN_KEPT_SHARE, MAX_LINE, MAX_LINE_SHARE, MIN_SEGMENT = 0.2, 400, 0.8, 12
CHUNK_TOKENS, CHUNK_OVERLAP, LABEL_OVERLAP = 256, 64, 10
WINDOW_CHARS, WINDOW_OVERLAP, NESTED_MIN = 900, 150, 40
TOP_K, QUERY_MAX, JUDGE_MAX, Z95 = 4, 400, 4000, 1.959964
PAIR_SEPARATOR, CONTEXT_SEPARATOR, NO_CONTEXT = " [SEP] ", "\n\n---\n\n", "(no usable context)"
TARGET_FPRS, BOOTSTRAP_N = (0.001, 0.01), 1_000
POSITIVE_NAMES = ("INJECTION", "LABEL_1", "1", "UNSAFE", "MALICIOUS", "JAILBREAK")

# --- fixed values: datasets -------------------------------------------------------------------------
VARIANTS, POSITIVE_SHARE, SYNTHETIC_VARIANTS, HELD_VARIANTS, SYNTHETIC_ATTACKS = 8, 0.5, 4, 2, 4_000
MAX_DOCS_PER_DOMAIN, LEAST_CHARS, CALIBRATION_MIN, TRAIN_SHARE = 150, 80, 5_000, 0.85
CANARY_PREFIX, CANARY_ALPHABET, CANARY_LENGTH = "CNRY", "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 8
PAYLOAD_CODE, PAYLOAD_NAME = 0.4, 0.8
POSITIONS = ("start", "middle", "end")
# --- end of fixed values --------------------------------------------------------------------------

MARKER = "[removed: suspected instruction]"
