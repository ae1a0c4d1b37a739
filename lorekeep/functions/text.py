"""Column functions over text records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: types, aliases, word lists and patterns of the record format ----
MEMORY_TYPES = ["solution", "decision", "conversation", "pattern", "project_context", "error_lesson", "fact", "episode"]
DURABLE_TYPES = ["fact", "solution", "decision", "pattern", "project_context", "error_lesson", "conversation"]
TYPE_ALIASES = {
    "knowledge": "fact", "note": "conversation", "memory": "conversation", "insight": "pattern", "preference": "decision", "lesson": "error_lesson",
    "error": "error_lesson", "bugfix": "solution", "fix": "solution", "context": "project_context", "summary": "project_context", "observation": "fact",
}
TROUBLESHOOT = [
    "why do", "why does", "why is", "why are", "why can't", "why won't", "why did", "why doesn't", "why don't", " fail", "failing", "failed", " broke", "broken", "breaks",
    " error", "exception", "i lost", "disappear", "not working", "won't work", "doesn't work", "security error", "authorization", "permission denied", "keeps failing", "keeps crashing",
]
DECISION = [
    "what did we decide", "what was decided", "why did we choose", "what approach", "what strategy", "what pattern", "how should we", "what's the best way", "which option",
    "trade-off", "tradeoff", "alternative",
]
STATUS = ["what happened", "what did we do", "status of", "what changed", "what was done", "progress on", "session summary", "recap of", "update on"]
FACTUAL = ["what is the cost", "what is the runtime", "what is the price", "how much does", "how many ", "are conversation threads", "is it visible"]
INTENTS = [("solution", TROUBLESHOOT), ("decision", DECISION), ("status", STATUS), ("fact", FACTUAL)]
TYPE_BOOST = {"solution": ["solution", "error_lesson"], "fact": ["fact"], "decision": ["decision", "pattern"], "status": ["project_context"]}
TRIVIAL_CONTENT = ["no actionable", "no code changes", "no significant", "no tasks were", "no decisions", "no meaningful", "empty session", "remained default", "test memory"]
REFLECTION_META = ["memories 0", "memory 0", "these memories", "the memories", "do not fit", "no clear pattern", "are related to"]
NOISY_REFLECTION = [
    "memories 0", "memory 0", "do not fit", "these memories", "the memories", "no clear pattern", "no actionable", "no significant", "empty session", "test memory", "as an ai",
]
TRIVIAL_SUMMARY = [
    "no actionable", "no code changes", "no significant", "no tasks", "no decisions", "empty session", "no meaningful", "remained default", "no user or assistant", "no substantive",
    "no user or assistant messages", "transcript contains no", "session transcript contains no", "placeholder text", "impossible to determine",
]
ENTITY_STOPLIST = [
    "git", "add", "commit", "push", "pull", "clone", "checkout", "merge", "rebase", "fetch", "origin", "remote", "branch", "stage", "staging", "run", "use", "using", "install", "update",
    "delete", "remove", "create", "commit_message", "branch_name", "repository_url", "repo_url", "file_path", "path", "url", "uri", "id", "name", "value", "key", "type", "foo", "bar",
    "code", "file", "files", "function", "component", "app", "application", "project", "system", "user", "data", "text", "string", "number",
]
ERROR_PATTERNS = [
    r"(?i)(traceback|exception|error|failed|fatal|panic)", r"(?i)\b(FAIL|FAILED|ERROR)\b", r"exit code [1-9]", r"(?i)command not found", r"(?i)permission denied",
    r"(?i)(ModuleNotFoundError|ImportError|SyntaxError|TypeError|ValueError|KeyError|AttributeError|FileNotFoundError)",
]
SKIP_COMMANDS = [r"^(ls|cat|head|tail|grep|find|wc|echo|pwd|cd|which|type|file)\b", r"^git\s+(status|log|diff|show|branch|remote)\b", r"^(python3?|node)\s+-c\b", r"^curl\s+-s\b.*\bstats\b"]
SKIP_FILES = [r"package-lock\.json$", r"\.d\.ts$", r"\.(log|tmp|bak)$", r"\.pyc$", r"node_modules/", r"__pycache__/", r"\.DS_Store$"]
TEST_PASS = r"(?i)\b(passed|(\d+)\s+passed|tests?\s+ok|all\s+green)\b"
ACTION_CONFIDENCE = {"error_fix": 0.9, "test_pass": 0.85, "session_error_fix": 0.85, "session_decision": 0.7, "write_source": 0.5, "edit_group": 0.5, "agent": 0.6}
FTS_SPECIAL = "\"'()[]{}^*?!~"
FTS_CHARS = 4096
STOPWORDS = """
a an the and or but if then than that this these those is are was were be been
being am do does did doing have has had having i me my we our you your he she
it its they them their of in on at to for from by with without into over under
again further once here there when where why how all any both each few more
most other some such no nor not only own same so too very can will just should
now as what which who whom don t s
""".split()
# ---- end of fixed values ----


def strip_ws(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def matches_any(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def strip_private(c: Column) -> Column:
    """Without <private>…</private> spans, in any case and over lines."""
    return F.regexp_replace(c, r"(?is)<private>.*?</private>", "")


def derive_title(content: Column, session: Column) -> Column:
    """A short label: the [label] prefix, else the first line, else the session."""
    t = strip_ws(F.coalesce(content, F.lit("")))
    sid = strip_ws(F.coalesce(session, F.lit("")))
    fallback = F.when(sid != "", F.concat(F.lit("session "), F.substring(sid, 1, 80))).otherwise("Untitled memory")
    label = strip_ws(F.regexp_extract(t, r"(?s)^\[([^\]]*)\]", 1))
    after = strip_ws(F.regexp_replace(t, r"(?s)^\[[^\]]*\]", ""))
    has_label = t.rlike(r"(?s)^\[[^\]]*\]") & (label != "") & (F.length(label) <= 240)
    role = F.lower(label).isin("user", "assistant") & (F.length(after) > 10)
    line = strip_ws(F.regexp_extract(t, r"^([^\r\n]*)", 1))
    return (
        F.when(t == "", fallback)
        .when(has_label & role, F.substring(F.concat(label, F.lit(": "), F.substring(after, 1, 72)), 1, 120))
        .when(has_label, F.substring(label, 1, 120))
        .when(line == "", fallback)
        .otherwise(F.substring(line, 1, 120))
    )


def normalize_entity(c: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(strip_ws(F.regexp_replace(c, r"\s+", " ")))


def clean_entities(names: Column, cap: int = 12) -> Column:
    """Names of 2 or more characters with a letter or digit, off the stop list, the first of each spelling, cap at most."""
    trimmed = F.transform(names, strip_ws)
    kept = F.filter(trimmed, lambda x: x.isNotNull() & (F.length(x) >= 2) & x.rlike(r"[\p{L}\p{N}]") & ~F.lower(x).isin(ENTITY_STOPLIST))
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, F.lower), F.lower(x)) == i + 1)
    return F.slice(first, 1, cap)


def sanitize_query(c: Column) -> Column:
    """Search tokens: letters, digits, - and ' stay, everything else separates; one-byte tokens go."""
    tokens = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}'-]+", " "), " ")
    return F.filter(tokens, lambda t: F.octet_length(t) >= 2)


def index_words(c: Column) -> Column:
    """Words as the index cuts them: ASCII letters and digits and every non-ASCII character; case as it is."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def ascii_lower(word: Column) -> Column:
    """A-Z in lower case, and no other character changed."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def fts_document(title: Column, content: Column) -> Column:
    """What the offline index holds of a record: title and content, 4096 characters."""
    return F.substring(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit(""))), 1, FTS_CHARS)


def fts_query(c: Column) -> Column:
    """A query with the special characters of the index language as blanks; hyphens stay."""
    return F.translate(c, FTS_SPECIAL, " " * len(FTS_SPECIAL))


def classify_intent(query: Column) -> Column:
    q = F.lower(query)
    out = F.when(contains_any(q, INTENTS[0][1]), INTENTS[0][0])
    for name, words in INTENTS[1:]:
        out = out.when(contains_any(q, words), name)
    return out


def normalize_type(raw: Column, default: str = "conversation") -> Column:
    s = strip_ws(F.coalesce(raw, F.lit("")))
    s = F.regexp_replace(s, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.lower(F.regexp_replace(s, r"[- ]", "_"))
    alias = F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv])
    s = F.coalesce(alias[s], s)
    return F.when(s.isin(MEMORY_TYPES), s).otherwise(default)


def classify_trivial(content: Column, source: Column) -> Column:
    """too_short, reflection_meta, trivial_content or null."""
    t = strip_ws(F.coalesce(content, F.lit("")))
    low = F.lower(t)
    return F.when(F.length(t) < 30, "too_short").when((source == "reflection") & contains_any(low, REFLECTION_META), "reflection_meta").when(contains_any(low, TRIVIAL_CONTENT), "trivial_content")


def noisy_reflection(text: Column) -> Column:
    t = strip_ws(text)
    return (F.octet_length(t) < 30) | contains_any(F.lower(t), NOISY_REFLECTION)


def trivial_summary(text: Column, decisions: Column, next_steps: Column) -> Column:
    empty = (F.size(F.coalesce(decisions, F.array())) == 0) & (F.size(F.coalesce(next_steps, F.array())) == 0)
    t = F.coalesce(text, F.lit(""))
    return empty & ((F.length(strip_ws(t)) < 40) | contains_any(F.lower(t), TRIVIAL_SUMMARY))


def skip_command(c: Column) -> Column:
    return matches_any(strip_ws(c), SKIP_COMMANDS)


def skip_file(c: Column) -> Column:
    return matches_any(c, SKIP_FILES)


def is_error(c: Column) -> Column:
    return matches_any(c, ERROR_PATTERNS)


def is_test_pass(c: Column) -> Column:
    return c.rlike(TEST_PASS)


def slug(c: Column, cap: int = 60) -> Column:
    """Lower case, runs of anything but letters and digits as one dash, cap characters."""
    s = F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, cap), "-+$", "")


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_\s-]", "_")


def snippet(c: Column, n: int) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def query_of(title: Column, content: Column) -> Column:
    """Evaluation query: a title of 12 characters or more, else the first sentence up to 200, else null."""
    first = strip_ws(F.substring(F.regexp_extract(strip_ws(F.coalesce(content, F.lit(""))), r"(?s)^(.*?)(?:[.!?](?:\s|$)|\n|$)", 1), 1, 200))
    return F.when(F.length(strip_ws(F.coalesce(title, F.lit("")))) >= 12, strip_ws(title)).when(first != "", first)


def content_words(c: Column) -> Column:
    """Distinct a-z0-9 tokens that aren't stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(STOPWORDS)))


def vocab_overlap(query: Column, content: Column) -> Column:
    """Share of the query's content words that the content has; 0 without any."""
    q, c = content_words(query), content_words(content)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone."""
    return F.unix_micros(c.cast("timestamp"))


def recency_weight(ts: Column, now: Column, half_life_days: float = 730.0) -> Column:
    age = F.greatest(F.lit(0.0), (micros(now) - micros(ts)) / F.lit(86_400_000_000.0))
    return F.lit(0.85) + F.lit(0.15) * F.pow(F.lit(0.5), age / half_life_days)


def salience_weight(s: Column) -> Column:
    return F.greatest(F.lit(0.85), F.least(F.lit(1.15), F.lit(1.0) + F.lit(0.3) * (s - 0.5)))


def barrier_threshold(n: Column, start: int = 18_000, span: int = 7_000) -> Column:
    """Confidence a new record needs in a corpus of n."""
    return F.when(n > start, F.lit(0.3) + F.lit(0.7) * F.pow(F.least((n - start) / F.lit(float(span)), F.lit(1.0)), 3)).otherwise(0.0)


def project_of_path(path: Column, known: dict[str, str], default: str = "general") -> Column:
    """The project of the last path part that is known."""
    parts = F.reverse(F.split(path, "/"))
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.element_at(F.filter(F.transform(parts, lambda p: table[p]), lambda x: x.isNotNull()), 1), F.lit(default))


def display_title(stem: Column, section: Column) -> Column:
    return F.when(section == stem, stem).otherwise(F.concat(stem, F.lit(" — "), section))


def json_object(c: Column) -> Column:
    """From the first { to the last }."""
    return F.regexp_extract(c, r"(?s)(\{.*\})", 1)


def strip_fence(c: Column) -> Column:
    """Without a ``` fence around the text."""
    t = strip_ws(c)
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n?```$", "")).otherwise(t)
