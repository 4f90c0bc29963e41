"""Text functions as column expressions: keys, titles, identifiers, URLs and reference lines.

White space is spelled out where Python's notion of it is meant, since the regular expressions of the JVM and of other
engines take only the ASCII part for \\s.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Unicode White_Space class.
WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
QUOTES = ("“”’–—", "\"\"'--")
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
YEAR = r"\b((?:18|19|20)\d{2}[a-z]?)\b"
URL = r"https?://[^\s,;)>\]]+"
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"
ARXIV = r"(?i)\barXiv\s*[:\x{FF1A}]?\s*(\d{4}\.\d{4,5}(?:v\d+)?)\b"

# Where the title of a reference ends at the latest.
TITLE_ENDS = (". In ", "? In ", ". Preprint", "? Preprint", ". arXiv", "? arXiv", ". In:", ". Proceedings", ". Transactions", ". Journal", ". Association for Computational Linguistics")
# Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref")


def by_row(f: Callable, kind: str) -> Callable[..., Column]:
    """A Python function of single texts for columns. Texts may be long and what is read from them longer: rows go to Python a hundred at a time, where Arrow would hold ten thousand and all their results at once."""
    return F.udf(f, kind, useArrow=False)


def squeeze(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def nfc(c: Column) -> Column:
    """Unicode NFC; rows whose text is ASCII reach Python as nulls only."""
    other = F.when(F.octet_length(c) != F.char_length(c), c)
    return F.coalesce(_nfc()(other), c)


def _nfc():
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return run


def normalize_name(c: Column) -> Column:
    """ST1: NFC and white space; case and punctuation stay, so BM-25 and BM25 differ."""
    return squeeze(nfc(c))


def name_key(raw: Column, kind: Column, scope: Column) -> Column:
    """ST2: normalised name, kind and scope between bars."""
    return F.concat_ws("|", normalize_name(raw), kind, scope)


def loose(c: Column) -> Column:
    """ST3: lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


def canonical_title(c: Column) -> Column:
    """ST5: soft hyphens and line-end hyphens go, quotes and dashes are plain, & is and, the rest are blanks."""
    joined = F.regexp_replace(F.replace(F.trim(c), F.lit("\u00ad"), F.lit("")), r"([A-Za-z])-\s+(?=[a-z])", "$1")
    return _spaced(F.replace(F.lower(F.translate(joined, *QUOTES)), F.lit("&"), F.lit(" and ")))


def canonical_raw(c: Column) -> Column:
    """ST6: the same for a whole reference, without the typographic steps."""
    return _spaced(F.regexp_replace(F.lower(F.trim(c)), r"([a-z])-\s+(?=[a-z])", "$1"))


def normalize_identifier(c: Column) -> Column:
    return F.lower(F.rtrim(F.trim(c), F.lit(".,;)")))


def plain_text(c: Column) -> Column:
    """ST8: soft hyphens and escapes of _ * # go, white space is squeezed."""
    return squeeze(F.regexp_replace(F.replace(c, F.lit("\u00ad"), F.lit("")), r"\\([_*#])", "$1"))


def join_fragments(left: Column, right: Column) -> Column:
    """ST8: two fragments of a line, without the hyphen that broke a word."""
    broken = left.rlike(f"[{LATIN}]-$") & right.rlike("^[a-zà-öø-ÿ]")
    return F.when(left == "", right).when(right == "", left).when(broken, F.concat(F.substring(left, F.lit(1), F.length(left) - 1), right)).otherwise(F.concat_ws(" ", left, right))


def canonical_reference(c: Column) -> Column:
    """ST7: rendering differences that do not matter: backslashes, quotes, dashes, blanks around punctuation."""
    c = F.translate(F.replace(plain_text(c), F.lit("\\"), F.lit("")), *QUOTES)
    c = F.regexp_replace(F.regexp_replace(c, r"\s+([,.;:!?])", "$1"), r"([(\[{])\s+", "$1")
    return squeeze(F.regexp_replace(c, r"\s+([)\]}])", "$1"))


def let(value: Column, then) -> Column:
    """then(value) with value computed once, where an expression needs it many times."""
    return F.get(F.transform(F.array(value), then), 0)


def _title(rest: Column) -> Column:
    end = F.least(*[F.when(F.instr(rest, e) > 1, F.instr(rest, e)) for e in TITLE_ENDS])
    return let(end, lambda e: F.trim(F.when(e.isNotNull(), F.substring(rest, F.lit(1), e - 1)).otherwise(F.get(F.split(rest, r"\.\s+", 2), F.lit(0))), F.lit(" .")))


def parse_title(rest: Column) -> Column:
    """ST10: up to the earliest known end, or else to the first full stop before a blank."""
    return let(rest, _title)


def parse_reference(raw: Column, fallback: bool = False) -> Column:
    """ST9: struct of authors, year, title, arxiv_ids, dois, urls, confidence and warnings; the first year divides."""
    found = lambda raw, pattern, group: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(pattern), F.lit(group)), lambda x: F.rtrim(x, F.lit(".")))))

    def divided(raw: Column) -> Column:
        year, at = F.regexp_extract(raw, YEAR, 1), F.regexp_instr(raw, F.lit(YEAR))
        authors = F.trim(F.substring(raw, F.lit(1), at - 1), F.lit(" .,:;"))
        rest = F.trim(F.substring(raw, at + F.length(year), F.length(raw)), F.lit(" .,:;"))
        return F.struct(raw.alias("raw"), year.alias("year"), F.when(year == "", "").otherwise(authors).alias("authors"), F.when(year == "", "").otherwise(parse_title(rest)).alias("title"))

    def record(d: Column) -> Column:
        raw, year, authors, title = d["raw"], d["year"], d["authors"], d["title"]
        warnings = F.array_compact(F.array(F.when(year == "", "no_year"), F.when(authors == "", "no_authors"), F.when(title == "", "no_title")))
        confidence = F.when((year == "") | (title == ""), "low").otherwise("medium" if fallback else "high")
        arxiv = F.array_sort(F.array_distinct(F.regexp_extract_all(raw, F.lit(ARXIV), F.lit(1))))
        return F.struct(authors.alias("authors"), year.alias("year"), title.alias("title"), arxiv.alias("arxiv_ids"), found(raw, DOI, 0).alias("dois"), found(raw, URL, 0).alias("urls"), confidence.alias("confidence"), warnings.alias("warnings"))

    return let(let(plain_text(raw), divided), record)


def is_reference_heading(c: Column) -> Column:
    """ST11: References, Bibliography or Works cited, numbered or marked as a heading."""
    return F.rtrim(plain_text(c), F.lit(".:")).rlike(r"(?i)^\s*(?:#+\s*)?(?:\d+(?:\.\d+)*\.?\s*)?(?:references?|bibliography|works\s+cited)\s*$")


START = rf"^\s*(?:\[\d+\]\s*|\d+\.\s*)?(?:[A-Z]\s+[A-Z][{LATIN}'`’.-]+|[A-Z][{LATIN}'`’.-]+|[A-Z]\.|[a-z][A-Za-z.-]*\.)"


def looks_like_start(c: Column) -> Column:
    """ST12: begins like a reference and has a year, or a URL early on."""
    return c.rlike(START) & (c.rlike(YEAR) | F.substring(c, 1, 240).rlike(URL))


def looks_like_authors(c: Column) -> Column:
    """ST12: begins like a reference and soon has a comma, an and, or et al."""
    head = F.substring(c, 1, 180)
    return c.rlike(START) & (head.contains(",") | head.contains(" and ") | head.contains(" et al"))


def looks_complete(c: Column) -> Column:
    """ST12: has a year and ends like a sentence or a bracket."""
    return c.rlike(YEAR) & c.rlike("[.!?。)\\]\"]\\s*$")


def person_name(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.replace(F.trim(c), F.lit("’"), F.lit("'")), f"[^{LATIN}'-]+", " ")))


def first_author(authors: Column) -> Column:
    """ST13: the surname of the first author, lower-cased."""
    first = F.get(F.split(F.get(F.split(authors, r"\s+(?:and|&)\s+|;", 2), F.lit(0)), ","), F.lit(0))
    return F.coalesce(F.get(F.reverse(F.split(person_name(first), " +")), F.lit(0)), F.lit(""))


def cited_surname(c: Column) -> Column:
    """ST13: the surname that a citation names, without et al., further authors and the genitive."""
    c = F.trim(F.regexp_replace(person_name(c), r"\bet\s+al\b\.?", ""))
    c = F.regexp_replace(F.trim(F.regexp_replace(c, r"\b(?:and|&)\b.*$", "")), "'s$", "")
    return F.get(F.split(c, " +"), F.lit(0))


def base_year(c: Column) -> Column:
    """ST13: the year without its letter."""
    year = F.lower(F.trim(c))
    return F.coalesce(F.nullif(F.regexp_extract(year, "^((?:19|20)[0-9]{2})", 1), F.lit("")), year)


def has_year_suffix(c: Column) -> Column:
    return F.lower(F.trim(c)).rlike("^(?:19|20)[0-9]{2}[a-z]$")


def clean_url(c: Column) -> Column:
    """ST18: without closing punctuation."""
    return F.rtrim(c, F.lit(".,;:!?)]}。，"))


def url_mentions(text: Column) -> Column:
    """ST18: the distinct URLs of a text in order of their first place."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>()\[\]{}\"'`]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, clean_url), lambda u: u != ""))


def _with_scheme(c: Column) -> Column:
    return F.when(F.instr(c, "://") > 0, c).otherwise(F.concat(F.lit("https://"), c))


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(_with_scheme(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(_with_scheme(c), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def normalize_url(c: Column) -> Column:
    """ST19: lower-case scheme and host, no fragment, no slash at the end, no tracking parameters."""
    c = _with_scheme(F.rtrim(F.trim(c), F.lit(".,;:!?)]}")))
    scheme = F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (F.instr(p, "=") > 0) & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    text = F.array_join(kept, "&")
    return F.concat(scheme, F.lit("://"), url_host(c), F.rtrim(url_path(c), F.lit("/")), F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def classify_url(c: Column) -> Column:
    """ST20: struct of kind (github, huggingface, arxiv_link or url) and key."""
    host, parts = url_host(c), F.split(F.trim(url_path(c), F.lit("/")), "/")
    part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    n = F.size(parts)
    hub = host.endswith("huggingface.co") | host.endswith("hf.co")
    github = host.endswith("github.com") & (n >= 2)
    typed = hub & part(0).isin("datasets", "spaces") & (n >= 3)
    model = hub & (n >= 2) & ~part(0).isin("papers", "blog", "docs", "collections")
    kind = F.when(github, "github").when(typed | model, "huggingface").when(host.endswith("arxiv.org"), "arxiv_link").otherwise("url")
    key = F.when(github, F.concat_ws("/", part(0), F.regexp_replace(part(1), r"\.git$", ""))).when(typed, F.concat_ws("/", part(0), part(1), part(2))).when(model, F.concat_ws("/", F.lit("models"), part(0), part(1))).otherwise(normalize_url(c))
    return F.struct(kind.alias("kind"), key.alias("key"))


def url_kind(c: Column) -> Column:
    """ST37: pdf, doi or landing."""
    return F.when(F.lower(url_path(c)).rlike(r"\.pdf$|/pdf/"), "pdf").when(url_host(c).endswith("doi.org"), "doi").otherwise("landing")


def slug(c: Column) -> Column:
    """ST21: lower-case letters and digits joined by single hyphens."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def norm_name(c: Column) -> Column:
    """ST22: a resource name without generic words; raised and lowered digits are plain."""
    raised = "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉"
    c = F.lower(F.translate(c, raised, "01234567890123456789"))
    c = F.regexp_replace(c, r"\((?:model|dataset|benchmark|code|tool)\)", "")
    return F.regexp_replace(F.regexp_replace(c, r"\b(framework|series|dataset|benchmark|corpus|model)\b", ""), "[^a-z0-9]+", "")


def section_title(c: Column) -> Column:
    """ST26: lower case without the first token of a title of several words, which serves numbers and drops other words as well."""
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"^[\dA-Za-z.\-]+\s+", "")))


def arxiv_id(c: Column) -> Column:
    """ST25: struct of id and version from an arXiv id or URL; nulls for anything else."""
    host = url_host(c)
    bare = F.when(F.instr(c, "/") == 0, F.trim(c)).when(host.isin("arxiv.org", "www.arxiv.org"), F.regexp_replace(F.regexp_extract(c, r"/(?:abs|pdf|html)/(.+)$", 1), r"\.pdf$", "")).when(c.rlike(r"^[a-z-]+/\d{7}(v\d+)?$"), c)
    good = bare.rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})(v\d+)?$")
    base = F.when(good, F.regexp_replace(bare, r"v\d+$", ""))
    return F.struct(base.alias("id"), F.when(good, F.nullif(F.regexp_extract(bare, r"(v\d+)$", 1), F.lit(""))).alias("version"))


def tokens(c: Column) -> Column:
    """RT8: runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def embedding_text(name: Column, aliases: Column, *fields: Column) -> Column:
    """RT10: name, known aliases and text fields on lines of their own; missing ones leave no line."""
    known = F.when(F.size(aliases) > 0, F.concat(F.lit("Also known as: "), F.array_join(aliases, ", ")))
    return F.concat_ws("\n", name, known, *[F.nullif(f, F.lit("")) for f in fields])


def embedding_key(model: Column, text: Column) -> Column:
    """HA1: 16 hex digits of the hash of model and text."""
    return F.substring(F.sha1(F.encode(F.concat(model, F.lit("\n"), text), "UTF-8")), 1, 16)


def crc_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")


def estimated_tokens(c: Column) -> Column:
    """AG21: bytes by four."""
    return F.floor(F.octet_length(c) / 4)


def head_and_tail(c: Column, budget: int) -> Column:
    """ST33: three quarters of the budget from the head and one from the tail of longer texts."""
    mark = F.lit("\n\n[... truncated for length ...]\n\n")
    return F.when(F.length(c) <= budget, c).otherwise(F.concat(F.substring(c, 1, budget * 3 // 4), mark, F.right(c, F.lit(budget // 4))))


def front_matter_line(name: str, c: Column) -> Column:
    """ST30: a line of a YAML header, quoted; null where the value is missing or empty."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ': "'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def dollar_math(c: Column) -> Column:
    r"""ST31: \( .. \) and \[ .. \] as $ and $$."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)\\\((.*?)\\\)", r"\$$1\$"), r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")


def good_author(c: Column) -> Column:
    """ST34: a name: no e-mail, no digits, at most 80 characters and eight words, no sentence."""
    return (F.length(F.trim(c)) > 0) & ~c.contains("@") & ~c.rlike("[0-9]") & (F.length(c) <= 80) & (F.size(F.split(F.trim(c), " +")) <= 8) & ~c.rlike(r"[.!?]\s+[A-Z][a-z]+ [a-z]")


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def box_overlap(a: tuple, b: tuple) -> Column:
    """MA1: the part of box a that lies in box b."""
    inner = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return F.when(box_area(*a) > 0, inner / box_area(*a)).otherwise(0.0)


def box_gap(a: tuple, b: tuple) -> Column:
    """MA1: the distance of two boxes; 0 where they touch or overlap."""
    apart = lambda i: F.greatest(a[i] - b[i + 2], b[i] - a[i + 2], F.lit(0.0))
    return _length(apart(0), apart(1))


def _length(x: Column, y: Column) -> Column:
    """The root of the sum of squares as SQL writes it: hypot rounds otherwise, which decides between equal distances."""
    return F.sqrt(x * x + y * y)


def box_centre_distance(a: tuple, b: tuple) -> Column:
    """MA1: the distance of the centres, from the sums of the corners."""
    return _length((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)


def box_midpoint_distance(a: tuple, b: tuple) -> Column:
    """The same from the centres themselves; the two round differently, so a caller keeps to one."""
    return _length((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def relative_box(inner: tuple, outer: tuple) -> Column:
    """MA1: the corners of a box as shares of another, within 0 and 1, to three places."""
    size = [F.coalesce(F.nullif(outer[i + 2] - outer[i], F.lit(0.0)), F.lit(1.0)) for i in (0, 1)]
    return F.array(*[F.round(F.least(F.greatest((c - outer[i % 2]) / size[i % 2], F.lit(0.0)), F.lit(1.0)), 3) for i, c in enumerate(inner)])


def resource_id(kind: Column, name: Column) -> Column:
    """ST21: kind and slug; names without letters and digits are unknown."""
    return F.concat(kind, F.lit("::"), F.coalesce(F.nullif(slug(name), F.lit("")), F.lit("unknown")))


def anthology_id(collection: Column, volume: Column, item: Column) -> Column:
    """ST21: C-V and the number of three digits in collections such as P19, otherwise C-V.number."""
    old = F.concat(collection, F.lit("-"), volume, F.format_string("%03d", item.try_cast("int")))
    return F.when(collection.rlike("^[A-Z][0-9]{2}$"), old).otherwise(F.concat(collection, F.lit("-"), volume, F.lit("."), item))
