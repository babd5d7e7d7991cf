"""Fixed values that results depend on; each operator takes its own list as an argument."""

# Words that text reports leave out.
STOP_WORDS = (
    "the be to of and a in that have i it for not on with he as you do at this but his by from they we say her she or "
    "an will my one all would there their what so up out if about who get which go me when make can like time no just him know "
    "take people into year your good some could them see other than then now look only come its over think also back after use two how our "
    "work first well way even new want because any these give day most us"
).split()
FREQUENCY_STOP_WORDS = STOP_WORDS + "is are was were been has had did does am pm ok okay yes yeah hey hi hello".split()
TEXT_STOP_WORDS = FREQUENCY_STOP_WORDS + "image omitted video audio document attached file message deleted".split()

# Terms of urgency.
URGENCY_TERMS = ["urgent", "asap", "emergency", "immediately", "help", "call me", "wire", "bank", "password", "secret", "confidential", "delete this", "dont tell"]

# Topics in the order in which ties are decided, with their names and terms.
TOPICS = {
    "financial": ("Financial & Invoicing", ["money", "paid", "payment", "invoice", "budget", "price", "cost", "bank", "transfer", "dollar", "usd", "crypto", "billing", "receipt", "wire", "fee", "account", "contract"]),
    "technical": ("Technical & Development", ["code", "bug", "error", "server", "database", "api", "deploy", "github", "fix", "test", "release", "build", "issue", "frontend", "backend", "log", "app", "system", "security"]),
    "scheduling": ("Scheduling & Meetings", ["meet", "meeting", "call", "schedule", "tomorrow", "today", "monday", "tuesday", "wednesday", "thursday", "friday", "weekend", "calendar", "zoom", "google meet", "time", "sync", "available", "reschedule"]),
    "travel": ("Travel & Logistics", ["flight", "hotel", "trip", "airport", "ticket", "travel", "car", "uber", "train", "booking", "arrival", "depart", "location", "drive", "destination", "passport", "visa"]),
    "operational": ("Operations & Tasks", ["task", "project", "client", "deadline", "review", "approve", "send", "document", "report", "status", "update", "complete", "action", "urgent", "priority", "checklist", "team"]),
    "social": ("Social & Celebrations", ["happy", "congrats", "birthday", "party", "dinner", "lunch", "weekend", "coffee", "fun", "game", "movie", "photo", "lol", "haha", "cool", "great", "awesome", "family", "friend"]),
}

# Numbers of the events that are milestones.
MILESTONES = [1, 100, 500, 1_000, 5_000, 10_000, 25_000, 50_000, 100_000, 250_000, 500_000]

WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]

# Unicode's Extended_Pictographic and Emoji_Presentation code points, as ranges.
EMOJI_RANGES = (
    "A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 2388 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE 2600-2605 2607-2612 2614-2685 2690-2705 "
    "2708-2712 2714 2716 271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2767 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 "
    "1F000-1F0FF 1F10D-1F10F 1F12F 1F16C-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1AD-1F1FF 1F201-1F20F 1F21A 1F22F 1F232-1F23A 1F23C-1F23F 1F249-1F53D 1F546-1F64F 1F680-1F6FF 1F774-1F77F "
    "1F7D5-1F7FF 1F80C-1F80F 1F848-1F84F 1F85A-1F85F 1F888-1F88F 1F8AE-1F8FF 1F90C-1F93A 1F93C-1F945 1F947-1FAFF 1FC00-1FFFD"
)
EMOJI = "[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in EMOJI_RANGES.split()) + "]"

#: Code points outside of the ranges' ends, in a few ranges.
NO_EMOJI = r"[^\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F000}-\x{1FFFD}]+"

# Patterns that Java and RE2 read alike.
URL = r"(?i)\bhttps?://[^\s<>\"{}|\\^`\[\]]+|\bwww\.[^\s<>\"{}|\\^`\[\]]+"
LOOSE_URL = r"(?i)https?://[^\s$.?#].[^\s]*"
MENTION = r"(?:^|\s)@([a-zA-Z0-9_]+)"
WORD = r"[\p{L}\p{N}]{3,}"
#: Before WORD: no word of digits alone (Java only).
NOT_A_NUMBER = r"(?!\d+(?![\p{L}\p{N}]))"
DATE = r"(?i)\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
