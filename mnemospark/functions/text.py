"""Scalar text functions as column expressions; only what SQL can't say is a pandas UDF."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the rules below.
TITLE_MIN, TITLE_MAX, DESCRIPTION_MAX, MAX_SOURCES, SCAN_BYTES = 8, 120, 240, 8, 65_536
RESOURCE_EXTENSIONS = ["rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "rb", "c", "h", "cpp", "md", "yaml", "yml", "toml", "json", "sh", "sql", "tf", "proto"]
SHORT_BODY, SEGMENT_CHARS, MAX_SEGMENTS = 1200, 1600, 64
ELLIPSIS = "…"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_whitespace(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return trimmed(F.regexp_replace(c, r"\s+", " "))


def strip_markup(c: Column) -> Column:
    """Without white space and leading heading, quote and list marks."""
    return trimmed(F.regexp_replace(trimmed(c), r"^[#>*+-]+", ""))


def truncate_words(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut at the last space if that leaves half of them at least."""
    prefix = F.left(c, F.lit(limit))
    head = F.regexp_extract(prefix, r"(?s)^(.*) ", 1)
    cut = F.when(prefix.contains(" ") & (F.length(head) >= limit // 2), head).otherwise(F.regexp_replace(prefix, r"\s+$", ""))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(cut, r"[\s,]+$", ""), F.lit(ELLIPSIS)))


def one_line_preview(c: Column, limit: int) -> Column:
    """White space collapsed, at most ``limit`` characters and an ellipsis."""
    return bounded_preview(collapse_whitespace(c), limit)


def bounded_preview(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(ELLIPSIS))).otherwise(c)


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))


def scanned(body: Column) -> Column:
    """The body's first ``SCAN_BYTES`` bytes, without a character that they end within."""
    start = F.make_valid_utf8(F.substring(body.cast("binary"), 1, SCAN_BYTES).cast("string"))
    return F.when(F.octet_length(body) <= SCAN_BYTES, body).otherwise(F.left(body, F.length(F.regexp_replace(start, "\uFFFD+$", ""))))


def content_lines(body: Column) -> Column:
    """The body's lines without marks, empty ones left out, of the scanned part."""
    lines = F.split(scanned(body), "\r?\n")
    return F.filter(F.transform(lines, strip_markup), lambda x: x != "")


def title_description(body: Column) -> Column:
    """struct(title, description) of a body by its first two lines.

    ``Subject: claim`` gives both; else a short first line is the title and the next line
    describes; a long first line only describes.
    """
    lines = content_lines(body)
    headline = collapse_whitespace(F.get(lines, F.lit(0)))
    following = collapse_whitespace(strip_markup(F.get(lines, F.lit(1))))
    subject = trimmed(F.substring_index(headline, ":", 1))
    claim = trimmed(F.regexp_replace(headline, r"(?s)^[^:]*:", ""))
    has_subject = headline.contains(":") & ~subject.contains(". ") & F.length(subject).between(TITLE_MIN, TITLE_MAX) & (claim != "")
    short = F.length(headline) <= TITLE_MAX
    title = F.when(has_subject, subject).when(short, headline)
    description = F.when(has_subject, truncate_words(claim, DESCRIPTION_MAX)).when(short, F.when(following != "", truncate_words(following, DESCRIPTION_MAX))).otherwise(truncate_words(headline, DESCRIPTION_MAX))
    return F.struct(title.alias("title"), description.alias("description"))


def source_citations(body: Column) -> Column:
    """URLs and directory-qualified source paths, in order, distinct, at most eight."""
    tokens = F.split(scanned(body), r"\s+")
    bare = F.transform(tokens, lambda t: F.regexp_replace(F.regexp_replace(t, "^[`\"'()\\[\\]<>]+|[`\"'()\\[\\]<>]+$", ""), r"[.,;:!?]+$", ""))
    path = r"^(?:[\p{L}\p{N}/._+@-]*/)[\p{L}\p{N}_+@-][\p{L}\p{N}._+@-]*\.(?:" + "|".join(RESOURCE_EXTENSIONS) + r")$"
    ok = lambda t: t.startswith("http://") | t.startswith("https://") | (t.rlike(path) & (F.octet_length(t) <= 200))
    return F.slice(F.array_distinct(F.filter(bare, ok)), 1, MAX_SOURCES)


def source_key(resource: Column) -> Column:
    return F.left(F.concat(F.lit("auto-"), F.sha2(resource, 256)), F.lit(17))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def wire_type(memory_type: Column, project: Column) -> Column:
    return F.when(memory_type == "working_context", memory_type).when(project == "__global__", "global").otherwise(F.coalesce(memory_type, F.lit("user")))


def scope_label(project: Column) -> Column:
    return F.when(project.isNull(), "unscoped").when(project == "__global__", "global").otherwise(project)


def percent_encode(c: Column) -> Column:
    """URL path escaping: spaces as %20, the unreserved marks - . _ ~ kept."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def percent_decode(c: Column) -> Column:
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def canonical_uri(id_: Column, project: Column) -> Column:
    return (
        F.when(project.isNull(), F.concat(F.lit("memory://unscoped/"), id_))
        .when(project == "__global__", F.concat(F.lit("memory://global/"), id_))
        .otherwise(F.concat(F.lit("memory://project/"), project, F.lit("/"), id_))
    )


def project_ident(url: Column) -> Column:
    """The last non-empty part of a repository address, without .git, in lower case."""
    parts = F.filter(F.split(url, "[/:]"), lambda x: x != "")
    return F.lower(F.regexp_replace(F.get(parts, F.size(parts) - 1), r"\.git$", ""))


def normal_tags(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rewrite_budget(baseline: Column) -> Column:
    n = F.length(trimmed(baseline))
    return n + F.floor(n / 2)


def merge_budget(total_chars: Column) -> Column:
    return F.floor(3 * total_chars / 4)


def tag_overlap(a: Column, b: Column) -> Column:
    """How many of b's tags, repeats counted, a has; 0 for nulls."""
    return F.coalesce(F.size(F.filter(b, lambda x: F.array_contains(a, x))), F.lit(0))


def within_days(a: Column, b: Column, days: int = 14) -> Column:
    """Whether two times are at most ``days`` whole days apart; false for nulls."""
    return F.coalesce(F.abs(((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86_400).cast("bigint")) <= days, F.lit(False))


def strip_code_fence(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t.startswith("```"), trimmed(F.regexp_replace(F.regexp_replace(t, r"^```(?:text|markdown)?", ""), r"(?:```)+$", ""))).otherwise(t)


def escape_attribute(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit("&quot;"))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by its column, ``-`` where it is null."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("-")))
    return out


def next_amendment(content: Column) -> Column:
    numbers = F.transform(F.regexp_extract_all(content, F.lit(r"(?m)^## Ammendment\s+(\d{1,18})\s*$"), 1), lambda x: x.cast("bigint"))
    return F.coalesce(F.array_max(numbers), F.lit(0)) + 1


def first_present(payload: Column, names: tuple[str, ...] = ("prompt", "user_prompt", "userPrompt", "message", "input", "text")) -> Column:
    """The first of a JSON payload's fields that is not blank."""
    return F.coalesce(*(F.nullif(trimmed(F.get_json_object(payload, f"$.{n}")), F.lit("")) for n in names))


def searchable_text(title: Column, description: Column, concept_type: Column, tags: Column, heading: Column, body: Column) -> Column:
    blank = F.lit("")
    return F.concat_ws("\n", *(F.coalesce(c, blank) for c in (title, description, concept_type, F.array_join(tags, " "), heading, body)))


# --- segmentation, stemming, links --------------------------------------------------------


def segment_markdown(body: str | None) -> list[tuple[int, str | None, str]]:
    """(ordinal, heading path, text) of a body's segments: one if short, else by headings, then by length."""
    if body is None:
        return []
    if len(body) <= SHORT_BODY:
        return [(0, None, body)]
    path: list[str] = []
    parts: list[tuple[str | None, list[str]]] = [(None, [])]
    for line in re.split("\r?\n", body):
        m = re.match(r"\s*(#{1,6})\s(.*)$", line)
        if m:
            path = [*path[: len(m[1]) - 1], m[2].strip()]
            if "\n".join(parts[-1][1]).strip():
                parts.append((None, []))
            parts[-1] = (" / ".join(path), parts[-1][1])
        parts[-1][1].append(line)
    texts = [(h, t) for h, lines in parts if (t := "\n".join(lines).strip())] or [(None, body)]
    cut = [(h, t[i : i + SEGMENT_CHARS]) for h, t in texts for i in range(0, len(t), SEGMENT_CHARS)]
    return [(k, h, t) for k, (h, t) in enumerate(cut[:MAX_SEGMENTS])]


SEGMENT_TYPE = T.ArrayType(T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("body", T.StringType())]))


@F.pandas_udf(SEGMENT_TYPE)
def segments(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: [{"ordinal": k, "heading_path": h, "body": t} for k, h, t in segment_markdown(b)])


def fold_word(word: str) -> str:
    """Lower case without diacritics."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)))


class Porter:
    """The Porter stemmer (1980), step by step; a character that is no vowel, a digit too, counts as a consonant."""

    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @staticmethod
    def shape(w: str) -> str:
        """c or v for each letter; y is a vowel after a consonant."""
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or c == "y" and i and out[i - 1] == "c" else "c"
        return out

    @classmethod
    def measure(cls, w: str) -> int:
        return len(re.findall(r"v+c+", cls.shape(w)))

    @classmethod
    def cvc(cls, w: str) -> bool:
        return len(w) >= 3 and cls.shape(w)[-3:] == "cvc" and w[-1] not in "wxy"

    @classmethod
    def double(cls, w: str) -> bool:
        return len(w) >= 2 and w[-1] == w[-2] and cls.shape(w)[-1] == "c"

    @classmethod
    def stem(cls, w: str) -> str:
        if not 3 <= len(w) <= LONGEST_STEMMED:
            return w
        if (w.endswith("sses") and len(w) > 4) or (w.endswith("ies") and len(w) > 3):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            if cls.measure(w[:-3]) > 0:
                w = w[:-1]
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and "v" in cls.shape(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif cls.double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif cls.measure(w) == 1 and cls.cvc(w):
                        w += "e"
                    break
        if w.endswith("y") and "v" in cls.shape(w[:-1]):
            w = w[:-1] + "i"
        for rules in (cls.STEP2, cls.STEP3):
            for end, new in sorted(rules, key=lambda r: -len(r[0])):
                if w.endswith(end):
                    if cls.measure(w[: -len(end)]) > 0:
                        w = w[: -len(end)] + new
                    break
        for end in sorted(cls.STEP4, key=lambda e: -len(e)):
            if w.endswith(end):
                base = w[: -len(end)]
                if cls.measure(base) > 1 and (end != "ion" or base[-1:] in ("s", "t")):
                    w = base
                break
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or m == 1 and not cls.cvc(w[:-1]):
                w = w[:-1]
        if cls.measure(w) > 1 and cls.double(w) and w.endswith("l"):
            w = w[:-1]
        return w


#: Words of more bytes are not stemmed.
LONGEST_STEMMED = 64


@functools.lru_cache(1 << 17)
def porter_term(word: str) -> str:
    """A word's stem, by its bytes: each byte of another alphabet is a consonant."""
    return Porter.stem(word.encode().decode("latin-1")).encode("latin-1").decode(errors="ignore")


def porter_words(text: str | None) -> list[str]:
    """Runs of letters and digits, folded and stemmed; marks above or below a letter are part of its word."""
    return [porter_term(w) for w in re.findall(r"[^\W_]+", fold_word(text or ""))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def porter_tokens(texts: pd.Series) -> pd.Series:
    """Case-folded, diacritics stripped, stemmed tokens."""
    return texts.map(porter_words)


def simple_tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits: the tokenizer that SQL can state."""
    return F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), "")


def inline_links(body: Column) -> Column:
    """array<struct<target, label, ordinal>> of inline and angle-bracket links."""
    found = F.regexp_extract_all(body, F.lit(r"(?<!!)\[[^\]\[]*\]\([^()\s]+(?:\s+\"[^\"]*\")?\)|<[a-zA-Z][a-zA-Z0-9+.-]*:[^<>\s]*>"), 0)
    target = lambda x: F.when(x.startswith("<"), F.regexp_extract(x, r"^<(.*)>$", 1)).otherwise(F.regexp_extract(x, r"\]\(([^()\s]+)", 1))
    label = lambda x: F.when(x.startswith("<"), F.regexp_extract(x, r"^<(.*)>$", 1)).otherwise(F.replace(F.regexp_extract(x, r"^\[([^\]]*)\]", 1), F.lit("`"), F.lit("")))
    return F.transform(found, lambda x, i: F.struct(target(x).alias("target"), label(x).alias("label"), i.alias("ordinal")))


def reference_id(reference: Column) -> Column:
    """The memory id that a local reference names, if it has a local form (not yet looked up)."""
    bare = F.regexp_extract(reference, r"^([^#?]*)", 1)
    found = (
        F.when(bare.rlike(r"^(?:\.\.)?/memories/.+\.md$"), F.regexp_extract(bare, r"^(?:\.\.)?/memories/(.+)\.md$", 1))
        .when(bare.startswith("memory://"), F.regexp_extract(bare, r"([^/]+)/*$", 1))
        .when(~bare.contains("/") & bare.endswith(".md"), F.regexp_extract(bare, r"^(.*)\.md$", 1))
    )
    return F.nullif(found, F.lit(""))


# The words that switch a setting on and off.
ON_WORDS, OFF_WORDS = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def parse_flag(c: Column) -> Column:
    """True, false, or null where the text is neither."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*ON_WORDS), F.lit(True)).when(word.isin(*OFF_WORDS), F.lit(False))


def version_stamp(model: Column, *prompts: Column) -> Column:
    """The model's name and the first 8 hex digits of the SHA-256 of its prompts."""
    return F.concat(model, F.lit(":"), F.left(F.sha2(F.concat(*prompts), 256), F.lit(8)))
