"""String functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
SYSTEM_NOTE = (
    r"(?i)^The TodoWrite tool|^Current runtime context|Current DSH file policy\s*:|Any available operation enforced by the DSH file sandbox"
    r"|^System\s*:|^\[System\s*:|^<system>|^You are an AI assistant|^Available tools|^The following tools|^<\|.*\|>|^System\b"
    r"|^\{\s*\"type\"\s*:\s*\"session/|^<antml:|^<task-notification\b|^<system-reminder\b"
    r"|^[\s\-\*\"'\[(]*(?:environment|runtime|file|approval)[\._ ](?:context|policy)\b|^<(?:environment|runtime)_context\b"
)
SECRET_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("github_pat", r"github_pat_[A-Za-z0-9_]{20,}"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}"),
    ("openai_key", r"\b(?:sk|pk)-[A-Za-z0-9]{16,}"),
    ("nvidia_key", r"nvapi-[A-Za-z0-9\-_]{16,}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9\-]{10,}"),
    ("aws_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"),
    ("bearer", r"(?i)Bearer\s+[A-Za-z0-9._~+/=\-]{16,}"),
    ("password_assign", r"(?i)(?:password|passwd|pwd|secret|api[_-]?key)\s*[:=]\s*['\"]?[^\s'\"]{8,}"),
)
PII_RULES = (
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("cn_mobile", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("cn_id", r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
)
PLACEHOLDER = "[已脱敏]"
NOISE = "我你他她它的了呢吗么还记得是有想请问谁哪帮"
ROLES = {
    "user": "user", "human": "user", "用户": "user",
    "assistant": "assistant", "ai": "assistant", "model": "assistant", "助手": "assistant", "gpt": "assistant",
    "tool": "tool", "function": "tool", "tool_call": "tool", "toolcall": "tool", "tool_calls": "tool",
    "reasoning": "reasoning", "thinking": "reasoning", "thought": "reasoning", "思维链": "reasoning", "reflect": "reasoning",
    "patch": "patch", "code_patch": "patch", "修改": "patch",
    "shell": "shell", "bash": "shell", "command": "shell",
    "system": "meta", "developer": "meta", "meta": "meta",
}
ERROR_KINDS = (
    ("quota", ("insufficient", "quota", "credit", "billing", "余额", "402", "exceeded your current quota", "payment")),
    ("auth", ("401", "403", "unauthorized", "invalid api key", "invalid_api_key", "鉴权", "permission denied", "forbidden")),
    ("model", ("unsupported_model", "model not found", "no such model", "does not exist", "模型不存在", "not supported on this endpoint")),
    ("rate", ("429", "rate limit", "too many requests", "限流", "并发上限")),
    ("transient", ("timeout", "timed out", "incompleteread", "remote disconnected", "connection", "network", "upstream", "502", "503", "504", "520", "temporarily unavailable", "winerror")),
    ("format", ("无法从模型输出解析 json", "返回空内容", "jsondecodeerror", "unterminated", "expecting", "json")),
)
BREAKS = "。！？；.!?;"


def strip(c: Column) -> Column:
    """Remove white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def prep_text(c: Column, limit: int = 4096) -> Column:
    """Stripped, cut to ``limit`` code points; null if nothing is left."""
    return F.nullif(F.substring(strip(c), 1, limit), F.lit(""))


def clip(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def is_system_note(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(SYSTEM_NOTE), F.lit(False))


def kind_of(src_id: Column) -> Column:
    return F.when(src_id.startswith("wiki_"), "wiki").when(src_id.startswith("mcp_") | src_id.startswith("dst_"), "memory").otherwise("message")


def origin_of(source: Column) -> Column:
    return F.when(source == "feed", "external").otherwise("native")


def workspace_of(cwd: Column) -> Column:
    """The last path segment, with either separator."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.coalesce(cwd, F.lit("")), r"[\\/]+$", ""), r"([^\\/]+)$", 1), F.lit("")), F.lit("(unknown)"))


def contains_folded(c: Column, needle: Column | str) -> Column:
    """Literal containment that ignores case."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(F.lower(c), F.lower(n))


def ngrams(c: Column, n: int) -> Column:
    """All substrings of ``n`` characters in order; in time linear in the text (``substring`` would walk it each time)."""
    c = F.coalesce(c, F.lit(""))
    chars, size = F.split(c, ""), F.greatest(F.length(c) - (n - 1), F.lit(0))
    out = F.slice(chars, 1, size)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(chars, k, size), lambda a, b: F.concat(a, b))
    return out


def trigrams(c: Column, cap: int | None = None, drop_noise: bool = True) -> Column:
    """Distinct substrings of three characters, in order of appearance."""
    grams = F.array_distinct(ngrams(c, 3))
    if drop_noise:
        grams = F.filter(grams, lambda g: ~g.rlike(f"^[{NOISE}]{{3}}$"))
    return grams if cap is None else F.slice(grams, 1, cap)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def identifiers(c: Column, cap: int = 5) -> Column:
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9][A-Za-z0-9_\-:.]{11,}"), F.lit(0)))
    return F.slice(F.filter(found, lambda x: x.rlike(r"[0-9_\-:.]") | (F.length(x) >= 16)), 1, cap)


def phrases(c: Column, cap: int = 4, least: int = 5) -> Column:
    """Windows of two, then of three words within each run of words; distinct without regard to case."""
    runs = F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z0-9_.\-]*(?:[ \t]+[A-Za-z][A-Za-z0-9_.\-]*)+"), F.lit(0))

    def windows(run: Column) -> Column:
        w = F.split(run, r"[ \t]+")
        of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(of(2), of(3))

    every = F.filter(F.flatten(F.transform(runs, windows)), lambda p: F.length(p) >= least)
    first = F.filter(every, lambda p, i: F.array_position(F.transform(every, lambda q: F.lower(q)), F.lower(p)) == i + 1)
    return F.slice(first, 1, cap)


def clamp_content(c: Column, limit: int = 120) -> Column:
    """Cut at the last break within ``limit`` if it leaves at least 60 %, else hard with an ellipsis."""
    text = strip(F.coalesce(c, F.lit("")))
    head = F.substring(text, 1, limit)
    cut = F.length(F.regexp_extract(head, rf"(?s)^(.*[{BREAKS}])", 1))
    return F.when(F.length(text) <= limit, text).when(cut > int(limit * 0.6), strip(F.substring(head, F.lit(1), cut))).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"(?U)\s+$", ""), F.lit("…")))


def redact(c: Column, pii: bool = True) -> Column:
    for _, rule in SECRET_RULES + (PII_RULES if pii else ()):
        c = F.regexp_replace(c, rule, PLACEHOLDER)
    return c


def scan_findings(c: Column, pii: bool = True, only: tuple[str, ...] | None = None) -> Column:
    """array<struct<kind, rule, snippet>>: every rule's matches (or those of ``only`` some), eight characters of the head and four of the tail."""

    def of(kind: str, name: str, rule: str) -> Column:
        snip = lambda m: F.when(F.length(m) > 16, F.concat(F.substring(m, 1, 8), F.lit("…"), F.right(m, F.lit(4)))).otherwise(m)
        return F.transform(F.regexp_extract_all(c, F.lit(rule), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("rule"), snip(m).alias("snippet")))

    rules = [("secret", *r) for r in SECRET_RULES] + [("pii", *r) for r in PII_RULES if pii]
    return F.concat(*[of(*r) for r in rules if only is None or r[1] in only])


def has_substance(c: Column, least: int = 4) -> Column:
    residue = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(PLACEHOLDER), F.lit("")), r"(?U)[\s\W_]+", "")
    return F.length(residue) >= least


def scrub(c: Column) -> Column:
    """Drop control, format and unassigned characters, but for line feeds and tabs."""
    return F.regexp_replace(c, r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\n\t]]", "")


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def normalize_role(c: Column, default: str = "assistant") -> Column:
    key = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), key), F.lit(default))


def classify_error(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for kind, keys in ERROR_KINDS:
        hit = F.lit(False)
        for k in keys:
            hit |= F.contains(low, F.lit(k))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unknown")


def bigram_containment(a: Column, b: Column) -> Column:
    """Share of the character bigrams of the shorter text that the other has."""
    x, y = F.array_distinct(ngrams(a, 2)), F.array_distinct(ngrams(b, 2))
    low = F.least(F.size(x), F.size(y))
    return F.when(low == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / low)


def content_lines(c: Column) -> Column:
    """Stripped lines that are not blank; lines end as text in Unicode ends them."""
    parts = F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]", -1)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(F.array_join(content_lines(c), "\n"), 256), 1, 16)


def label_shell(c: Column, least: int = 5, ratio: float = 0.3) -> Column:
    """Is a text mostly bare labels: short lines that end in a colon?"""
    lines = content_lines(c)
    labels = F.filter(lines, lambda x: x.rlike(r"[:：]$") & (F.length(x) <= 40))
    return (F.size(lines) >= least) & (F.size(labels) / F.greatest(F.size(lines), F.lit(1)) >= ratio)


def visible_length(html: Column) -> Column:
    """Characters of a page that a reader sees."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]+>", " ")
    return F.length(F.btrim(F.regexp_replace(c, r"\s+", " ")))


def citations(c: Column) -> Column:
    """Ids cited as ``[m<id>]``, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[m(\d+)\]"), F.lit(1)), lambda x: x.cast("bigint"))))


def wiki_links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"), F.lit(1))


def link_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)[\s_\-—–·:：/\\]+", ""))


def split_front(c: Column) -> Column:
    """struct<front, body> of a Markdown page."""
    front = F.regexp_extract(c, r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*\r?\n?", 1)
    return F.struct(front.alias("front"), F.regexp_replace(c, r"(?s)\A---\r?\n.*?\r?\n---[ \t]*\r?\n?", "").alias("body"))


def front_value(front: Column, key: str) -> Column:
    raw = F.regexp_extract(front, rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(raw, "^[\"'](.*)[\"']$", "$1"), F.lit(""))


def title_of(c: Column) -> Column:
    """First heading outside code fences."""
    bare = F.regexp_replace(c, r"(?ms)^(```|~~~).*?^\1[ \t]*$", "")
    return F.nullif(strip(F.regexp_extract(bare, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$", 1)), F.lit(""))


def safe_name(c: Column, limit: int = 80) -> Column:
    kept = F.regexp_replace(F.regexp_replace(c, r"[\\/:*?\"<>|\x00-\x1f]+", "_"), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.btrim(kept), r"^[. ]+|[. ]+$", ""), 1, limit), F.lit("")), F.lit("untitled"))


def table_cell(c: Column, limit: int = 300) -> Column:
    return clip(F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\|", r"\\|"), r"\s+", " ")), limit)


def private_host(url: Column) -> Column:
    """Hosts that a fetch must not reach: names and literals of local and private networks."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1), F.lit("")))
    return (host == "") | host.rlike(r"^(?:localhost|.*\.(?:localhost|local|internal))$|^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^\[(?:::1?|f[cd][0-9a-f]*:.*|fe80:.*)\]$|^\d+$|^0x[0-9a-f]+$")
