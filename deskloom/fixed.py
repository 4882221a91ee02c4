"""Rule lists, patterns, word lists, templates and limits.

Everything here is data that results depend on. No logic lives in this file.
Patterns are written in the dialect shared by Python and Java; the flags are
added where they are used.
"""

# --- limits -----------------------------------------------------------------

SMALL_DOC_CHARS = 3000
CHUNK_CHARS = 1200
CHUNK_OVERLAP = 200
FILE_CANDIDATES = 8
TOP_K = 3
TOP_CHUNKS = 2
RRF_K = 60
VOCABULARY = 50_000
QUERY_CHARS = 512
SUBJECT_CHARS = 300
CONVERSATION_CHARS = 4000
SNIPPET_CHARS = 1500
TOOLS_CHARS = 2000
REASONING_CHARS = 500
LANGUAGE_CHARS = 5
REPORT_ERRORS = 20
REPORT_WARNINGS = 10

# --- text -------------------------------------------------------------------

# What Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
INVISIBLE = "[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
CYRILLIC = (
    "\u0430\u0435\u043e\u0440\u0441\u0445\u0456\u0454\u0455\u0443"
    "\u0412\u0421\u0415\u041d\u041a\u041c\u041e\u0420\u0422\u0425\u0410"
)
CYRILLIC_AS_LATIN = "aeorcxiesyBCEHKMOPTXA"
WORD = r"[\p{L}\p{N}_]{2,}"
# Marks a chunk may end behind, by rank.
CHUNK_MARKS = ["\n\n", ". ", "? ", "! ", "\n"]

# --- prompt-injection rules ---------------------------------------------------
# (family, reason, pattern, gate). The gate is our own addition: groups of
# lower-case literals; a text can only match the pattern if it contains at
# least one literal of every group.

INJECTION_RULES = [
    ("override", "ignore-instructions", r"ignore\s+(previous|all|above|prior|your)\s+(instructions?|rules?|guidelines?|prompt|directive)", [["ignore"]]),
    ("override", "disregard-instructions", r"disregard\s+(your|previous|all|any)\s+(instructions?|rules?|guidelines?|training)", [["disregard"]]),
    ("override", "forget-instructions", r"forget\s+(?:\w+\s+){0,3}(instructions?|rules?|guidelines?|training|constraints?)", [["forget"]]),
    ("override", "game-framing", r"(play\s+a\s+game|let'?s\s+(play|pretend))\s+(where|in\s+which|and)\s+you\s+(forget|ignore|have\s+no|bypass)", [["play", "pretend"], ["you"]]),
    ("override", "override-instructions", r"override\s+(your|the|all)\s+(instructions?|safety|rules?|filters?|guidelines?)", [["override"]]),
    ("override", "bypass-safety", r"bypass\s+(your|the|all)\s+(safety|filters?|restrictions?|rules?|guidelines?|instructions?)", [["bypass"]]),
    ("override", "set-aside-instructions", r"(set\s+aside|discard|drop|erase)\s+(your|all|the|previous)\s+(instructions?|rules?|guidelines?|constraints?|training)", [["aside", "discard", "drop", "erase"], ["instruction", "rule", "guideline", "constraint", "training"]]),
    ("override", "no-longer-apply", r"no\s+longer\s+(apply|follow|use|adhere\s+to)\s+(your|the|these|those)\s+(instructions?|rules?|guidelines?)", [["longer"]]),
    ("persona", "persona-override", r"you\s+are\s+now\s+(a|an|the)\s+\w+", [["now"], ["you"], ["are"]]),
    ("persona", "pretend-directive", r"(pretend|act)\s+(you\s+are|to\s+be|as\s+(if|a|an))", [["pretend", "act"]]),
    ("persona", "new-system-prompt", r"new\s+(system\s+prompt|persona|role|instruction|directive|identity)", [["new"], ["system", "persona", "role", "instruction", "directive", "identity"]]),
    ("persona", "new-role", r"your\s+new\s+(instructions?|rules?|role|persona|task)", [["your"], ["new"]]),
    ("persona", "from-now-on", r"from\s+now\s+on\s+(you\s+are|act|behave|respond)", [["from"], ["now"]]),
    ("persona", "role-switch", r"(switch|change|adopt|assume)\s+(to|your|a|an)?\s*(new\s+)?(role|persona|identity|mode|character)", [["switch", "change", "adopt", "assume"], ["role", "persona", "identity", "mode", "character"]]),
    ("persona", "roleplay-as", r"(roleplay|role-play|role\s+play)\s+as", [["play"], ["role"]]),
    ("persona", "simulation-attack", r"simulate\s+(being|a|an)\s+\w+\s+(without|that\s+ignores?|with\s+no)", [["simulate"]]),
    ("extraction", "system-prompt-extraction", r"(reveal|show|print|output|display|repeat|share|tell\s+me)\s+(your|the)\s+(system\s+prompt|instructions?|prompt|config|rules?|directives?)", [["prompt", "instruction", "config", "rule", "directive"], ["reveal", "show", "print", "output", "display", "repeat", "share", "tell"]]),
    ("extraction", "instructions-query", r"what\s+(are|were)\s+your\s+(instructions?|rules?|guidelines?|prompt|directives?)", [["what"], ["your"]]),
    ("extraction", "config-dump", r"(output|print|leak|dump|expose)\s+(your|the)\s+(system|internal|hidden|full)\s+(prompt|instructions?|config|rules?)", [["output", "print", "leak", "dump", "expose"], ["prompt", "instruction", "config", "rule"]]),
    ("extraction", "internals-query", r"(tell|show)\s+me\s+(how\s+you\s+work|your\s+configuration|your\s+setup|what\s+you\s+(were\s+)?told)", [["tell", "show"], ["work", "configuration", "setup", "told"]]),
    ("extraction", "echo-instructions", r"(repeat|echo|reproduce|copy)\s+(your|the|these|those)\s+(system\s+)?(instructions?|prompt|rules?)", [["repeat", "echo", "reproduce", "copy"], ["instruction", "prompt", "rule"]]),
    ("jailbreak", "jailbreak", r"\bjailbreak\b", [["jailbreak"]]),
    ("jailbreak", "DAN-mode", r"\bDAN\s+mode\b", [["dan"], ["mode"]]),
    ("jailbreak", "developer-mode", r"\bdeveloper\s+mode\b", [["developer"], ["mode"]]),
    ("jailbreak", "DAN", r"\bdo\s+anything\s+now\b", [["anything"]]),
    ("jailbreak", "grandma-exploit", r"\bgrandma\s+exploit\b", [["grandma"]]),
    ("jailbreak", "token-smuggling", r"\btoken\s+smuggling\b", [["smuggling"]]),
    ("jailbreak", "explicit-injection-mention", r"\bprompt\s+injection\b", [["injection"]]),
    ("jailbreak", "god-mode", r"(god|admin|root|super)\s*mode", [["mode"], ["god", "admin", "root", "super"]]),
    ("jailbreak", "unrestricted-mode", r"(unrestricted|unlimited|uncensored|unfiltered)\s+(mode|access|version|ai)", [["unrestricted", "unlimited", "uncensored", "unfiltered"]]),
    ("output", "classification-manipulation", r"(classify|mark|set|label|change|make|force)\s+(this|the\s+ticket|status|response)\s+(as|to)\s+(replied|escalated|resolved|high|low|closed)", [["classify", "mark", "set", "label", "change", "make", "force"], ["replied", "escalated", "resolved", "high", "low", "closed"], ["this", "ticket", "status", "response"]]),
    ("output", "response-manipulation", r"(respond|reply|answer)\s+(with|saying|by\s+saying)\s+[\"']?(yes|replied|escalated|resolved)", [["respond", "reply", "answer"], ["with", "saying"]]),
    ("output", "forced-output", r"(always|must|should)\s+(respond|reply|output|return)\s+(with|as|by)", [["always", "must", "should"], ["respond", "reply", "output", "return"]]),
    ("output", "forced-output", r"your\s+(response|answer|output)\s+(must|should|will)\s+(be|contain|say|include)", [["your"], ["response", "answer", "output"]]),
    ("output", "exact-output-demand", r"(output|return|produce|generate)\s+exactly\s+[\"']", [["exactly"]]),
    ("authority", "authority-claim", r"(this\s+is|i\s+am|we\s+are)\s+(a\s+test|testing|an?\s+admin|anthropic|google|openai|the\s+developer|your\s+creator|the\s+engineer|the\s+evaluator|internal\s+team)", [["test", "admin", "anthropic", "google", "openai", "developer", "creator", "engineer", "evaluator", "internal"]]),
    ("authority", "authority-claim", r"(as|i\s+am)\s+(your|an?)\s+(admin|administrator|developer|creator|owner|operator|supervisor)", [["admin", "developer", "creator", "owner", "operator", "supervisor"]]),
    ("authority", "authority-access", r"(authorized|authorised|permitted|allowed)\s+(to\s+)?(override|bypass|access|modify)\s+(your|the)\s+(rules?|safety|instructions?|config)", [["authorized", "authorised", "permitted", "allowed"]]),
    ("authority", "emergency-protocol", r"(emergency|critical|urgent)\s+(protocol|override|access|mode)\s+(alpha|beta|initiated|activated|enabled)", [["emergency", "critical", "urgent"]]),
    ("authority", "code-word-trigger", r"(password|passphrase|code\s+word)\s*(is|:)\s*\w+.*?(now\s+)?(bypass|ignore|skip|override)", [["password", "passphrase", "word"], ["bypass", "ignore", "skip", "override"]]),
    ("template", "script-injection", r"<\s*script[\s>]", [["script"], ["<"]]),
    ("template", "template-injection", r"\{\{.*?\}\}", [["{{"], ["}}"]]),
    ("template", "template-injection", r"\{%.*?%\}", [["{%"], ["%}"]]),
    ("template", "fake-xml-tag", r"<\s*(system|instruction|prompt|override)\s*>", [["<"], ["system", "instruction", "prompt", "override"]]),
    ("template", "fake-bracket-tag", r"\[\s*(system|admin|override|instruction|ignore)\s*\]", [["["], ["system", "admin", "override", "instruction", "ignore"]]),
    ("multilingual", "FR-injection", r"ignorez\s+(les|vos)\s+instructions", [["ignorez"]]),
    ("multilingual", "ES-injection", r"ignorar\s+(las|sus|tus)\s+instrucciones", [["ignorar"]]),
    ("multilingual", "DE-injection", r"ignoriere\s+(die|deine|ihre)\s+anweisungen", [["ignoriere"]]),
    ("multilingual", "IT-injection", r"ignora\s+(le|tue|le\s+precedenti)\s+istruzioni", [["ignora"]]),
    ("multilingual", "JA-injection", r"無視\s*(し|して|する)", [["無視"]]),
    ("multilingual", "ZH-injection", r"忽略\s*(之前|所有|你的)\s*(指令|指示|规则)", [["忽略"]]),
    ("multilingual", "KO-injection", r"이전\s*지침을\s*무시", [["무시"]]),
    ("multilingual", "RU-injection", r"игнорируй\s*(все|предыдущие|твои)\s*(инструкции|правила)", [["игнорируй"]]),
    ("exfiltration", "exfiltration", r"(send|email|forward|exfiltrate|transmit|post)\s+(all|the|your|this)\s+(data|tickets?|corpus|documents?|context|information)", [["send", "email", "forward", "exfiltrate", "transmit", "post"], ["data", "ticket", "corpus", "document", "context", "information"]]),
    ("exfiltration", "corpus-dump", r"(list|enumerate|dump|print\s+all)\s+(all|every)\s+(ticket|document|file|corpus|user)", [["list", "enumerate", "dump", "print"], ["ticket", "document", "file", "corpus", "user"], ["all", "every"]]),
    ("exfiltration", "data-harvest", r"(extract|copy|steal|harvest)\s+(all|the|every)\s+(data|record|entry|row|ticket)", [["extract", "copy", "steal", "harvest"], ["data", "record", "entry", "row", "ticket"]]),
    ("false-context", "false-context", r"the\s+(previous|last|above|prior)\s+(agent|assistant|bot|system|ai)\s+(said|told|instructed|confirmed|agreed)", [["previous", "last", "above", "prior"], ["said", "told", "instructed", "confirmed", "agreed"]]),
    ("false-context", "false-context", r"the\s+last\s+support\s+(agent|rep|person|team)\s+said", [["last"], ["support"], ["said"]]),
    ("false-context", "embedded-system-tag", r"system\s*:\s*(you\s+are|ignore|forget|override)", [["system"], [":"]]),
    ("false-context", "false-prior-agreement", r"(as\s+per|according\s+to)\s+(your|the|our)\s+(previous|last|prior)\s+(message|response|instruction|agreement|conversation)", [["per", "according"], ["previous", "last", "prior"], ["message", "response", "instruction", "agreement", "conversation"]]),
    ("false-context", "false-prior-agreement", r"(you\s+already|you\s+previously|you\s+have\s+already)\s+(agreed|confirmed|said|told me)\s+(that|to)", [["already", "previously"], ["agreed", "confirmed", "said", "told me"]]),
    ("false-context", "false-policy", r"(internal|hidden|secret)\s+(policy|rule|instruction|override|protocol)\s+(says?|states?|allows?|permits?)", [["internal", "hidden", "secret"], ["say", "state", "allow", "permit"]]),
    ("false-context", "false-tag-bypass", r"tickets?\s+(marked?|labeled?|tagged?)\s+(urgent|vip|priority|override)\s+(bypass|skip|ignore)", [["ticket"], ["bypass", "skip", "ignore"]]),
    ("output", "classification-manipulation", r"set\s+the\s+(status|priority|label|category)\s+(of\s+(this|the)\s+ticket\s+)?to\s+\w+", [["set"], ["status", "priority", "label", "category"]]),
    ("output", "classification-manipulation", r"force\s+(classify|categorize|label|mark|tag)\s+(this|the)?\s*ticket", [["force"], ["ticket"]]),
    ("exfiltration", "data-harvest", r"(extract|pull|get|retrieve)\s+(every|all|each)\s+(user|record|entry|row|ticket|document)", [["extract", "pull", "get", "retrieve"], ["user", "record", "entry", "row", "ticket", "document"], ["every", "all", "each"]]),
    ("exfiltration", "exfiltration", r"(forward|send|email|transmit)\s+all\s+[\w\s]*(data|records?|tickets?|documents?)\s+(to\s+)?\S+@\S+", [["forward", "send", "email", "transmit"], ["@"], ["all"]]),
    ("exfiltration", "exfiltration", r"(forward|send|transmit)\s+(all|every|the\s+entire)\s+(support|ticket|user|corpus|system)", [["forward", "send", "transmit"], ["support", "ticket", "user", "corpus", "system"]]),
    ("social", "persona-override", r"assume\s+(that\s+)?you\s+are\s+a\s+(helpful|different|better|new|unrestricted)", [["assume"]]),
    ("social", "social-engineering", r"(truly|really|actually|genuinely)\s+helpful\s+(ai|assistant|bot|model)\s+would\s+not\s+(refuse|decline|reject|block)", [["helpful"]]),
    ("social", "social-engineering", r"refusing\s+(this|my)\s+request\s+is\s+(actually\s+)?(harmful|wrong|unethical|discriminatory|illegal)", [["refusing"]]),
    ("social", "social-engineering", r"(safety\s+rules?|guidelines?|restrictions?|filters?)\s+are\s+(discriminating|discriminatory|biased|unfair|preventing|blocking)\s+(against\s+)?me", [["rule", "guideline", "restriction", "filter"], ["discriminating", "discriminatory", "biased", "unfair", "preventing", "blocking"]]),
    ("social", "social-engineering", r"you\s+should\s+know\s+that\s+refusing", [["refusing"]]),
    ("social", "social-engineering", r"(refusing|declining|blocking)\s+(to\s+)?(help|answer|respond|process)\s+is\s+(actually\s+)?(harm|discriminat|illegal|wrong|unethical)", [["refusing", "declining", "blocking"]]),
]

SCORE_CONFIRMING = 0.75
SCORE_SOLE_SIGNAL = 0.85

# --- personal data ------------------------------------------------------------
# (type, pattern, ignore case, placeholder or None when only detected)

PII_RULES = [
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|(?:2131|1800|35\d{3})\d{11}|\d{4}[\s\-]\d{4}[\s\-]\d{4}[\s\-]\d{4})\b", False, "[CARD-REDACTED]"),
    ("ssn", r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b", False, "[SSN-REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", False, "[EMAIL-REDACTED]"),
    ("phone_us", r"\b(?:\+?1[\s\-.]?)?\(?[2-9]\d{2}\)?[\s\-.]?[2-9]\d{2}[\s\-.]?\d{4}\b", False, "[PHONE-REDACTED]"),
    ("phone_in", r"\b(?:\+91|0)?[-\s]?[6-9]\d{4}[\s\-]?\d{5}\b", False, "[PHONE-REDACTED]"),
    ("aadhaar", r"\b[2-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}\b", False, "[AADHAAR-REDACTED]"),
    ("pan", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", False, "[PAN-REDACTED]"),
    ("passport", r"\b[A-Z]{1,2}[0-9]{6,9}\b", False, "[PASSPORT-REDACTED]"),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", False, None),
    ("date_of_birth", r"\b(?:dob|date\s+of\s+birth|born\s+on|birthdate)[:\s]+\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\b", True, None),
]
# Placeholders for the two types that are masked in strict mode only.
STRICT_PLACEHOLDERS = {"ip_address": "[IP-REDACTED]", "date_of_birth": "[DOB-REDACTED]"}

# --- routing ------------------------------------------------------------------

LEGAL_KEYWORDS = [
    "lawsuit", "sue you", "suing", "legal action", "take legal",
    "attorney", "lawyer", "court", "litigation", "file a complaint",
    "consumer protection", "class action", "regulatory", "gdpr complaint",
    "small claims", "arbitration", "demand letter",
]
FRAUD_KEYWORDS = [
    "identity theft", "stolen card", "stolen my card", "card stolen",
    "unauthorized transaction", "unauthorized charge", "fraudulent charge",
    "someone used my card", "someone hacked", "account hacked",
    "hacked my account", "unauthorized access", "account takeover",
    "compromised account", "phishing", "scammed", "scam",
]
EXFILTRATION_KEYWORDS = [
    "send me all", "dump all", "export all users", "list all tickets",
    "print all data", "extract all records", "show me all entries",
]

STATUSES = ["replied", "escalated"]
REQUEST_TYPES = ["product_issue", "feature_request", "bug", "invalid"]
RISK_LEVELS = ["low", "medium", "high", "critical"]
PII_FLAGS = ["true", "false"]
UNKNOWN_COMPANY = "unknown"

# --- canned texts -------------------------------------------------------------

RESPONSE_INJECTION = (
    "We were unable to process this request. "
    "If you have a genuine support question, please resubmit it without "
    "any instructions directed at the support system."
)
RESPONSE_FRAUD = (
    "This matter requires immediate attention from our specialist team. "
    "Your case has been escalated to our fraud and security team who will "
    "contact you within 24 hours. If you believe your account is actively "
    "compromised, please also contact your bank directly."
)
RESPONSE_LEGAL = (
    "Thank you for reaching out. This matter has been escalated to our "
    "legal and compliance team, who will review your case and respond "
    "within 2 business days."
)
RESPONSE_DEFAULT = (
    "Your request has been escalated to a human support specialist who "
    "will review your case and respond as soon as possible. "
    "We apologize for any inconvenience."
)
RESPONSE_OUT_OF_SCOPE = (
    "Thank you for reaching out. Unfortunately, this request falls outside "
    "the scope of our support services. If you believe this was sent in error "
    "or have a different question, please don't hesitate to reach out again."
)
RESPONSE_DIFFICULTIES = (
    "We are experiencing technical difficulties. "
    "Your request has been noted and a support agent will follow up shortly."
)
RESPONSE_ERROR = (
    "We encountered an issue processing your request. "
    "A support agent will follow up shortly."
)
REASONING_INJECTION = "Prompt injection detected by safety layer — classified directly"
REASONING_FALLBACK = "Classification failed — safe defaults applied"
JUSTIFICATION_EMPTY = "See response above"
JUSTIFICATION_INJECTION = "Prompt injection detected; immediate escalation. Reasons: "
JUSTIFICATION_ERROR = "Processing error: incomplete row"
ROUTE_PREFIX = " | Route: "
JUSTIFICATION_FALLBACK = "Responder API failure — fallback response issued"
CONFIDENCE_INJECTION = 0.99
CONFIDENCE_FALLBACK = 0.1
CONFIDENCE_MISSING = 0.5

REASON_PATTERNS = "patterns: "
REASON_RISK = "risk_level="
REASON_LOW_RISK = "; no corpus docs but low risk"
REASON_NONE = "no reason recorded"
REASON_INJECTION = "prompt injection detected"
REASON_CRITICAL = "risk_level=critical"
REASON_LEGAL = "legal threat: "
REASON_FRAUD = "fraud/identity theft: "
REASON_EXFILTRATION = "data exfiltration attempt: "
REASON_HIGH_NO_DOCS = "risk_level=high with no supporting corpus documents"
REASON_UNKNOWN_COMPANY = "unknown company with high/critical risk — cannot safely answer"
REASON_GROUNDED = "corpus documents found; proceeding with grounded response"
REASON_OUT_OF_SCOPE = "request out of scope; replying with out-of-scope message"
REASON_GUIDANCE = "replying with general guidance and escalation offer"
REASON_AMBIGUOUS = "ambiguous risk with no corpus support — defaulting to escalation"

NO_DOCS_SECTION = "(No corpus documents found for this ticket)"
NO_TOOLS_SECTION = "(No internal actions available)"

# --- output table -------------------------------------------------------------

OUTPUT_COLUMNS = [
    "issue", "subject", "company", "response", "product_area",
    "status", "request_type", "justification", "confidence_score",
    "source_documents", "risk_level", "pii_detected", "language",
    "actions_taken",
]

# Tools whose effect cannot be undone without a verified identity.
DESTRUCTIVE_TOOLS = ["issue_refund", "reset_password", "lock_account", "modify_subscription"]
VERIFY_TOOL = "verify_identity"

# --- word lists ---------------------------------------------------------------

# Words of two or more letters in Spark's English stop-word list.
STOP_WORDS = [
    "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself",
    "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its",
    "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom",
    "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "having", "do", "does", "did", "doing", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about",
    "against", "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further",
    "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "can", "will", "just", "don", "should", "now",
    "cannot", "could", "ought", "would",
]

# Function words that tell four languages apart (own choice, for language_id).
LANGUAGE_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ich", "ein", "eine", "zu", "den", "mit", "von", "auf", "sie"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "was", "you", "are", "this", "not"],
    "es": ["el", "la", "de", "que", "y", "los", "las", "un", "una", "por", "con", "para", "no", "se", "del"],
    "fr": ["le", "la", "les", "de", "et", "est", "un", "une", "des", "que", "pour", "pas", "dans", "ne", "du"],
}
