"""Column expressions for text, URLs, dates, casts and hashes. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from greenledger import rules

# Blank characters, written as escapes so that Java and RE2 read them alike.
BLANK = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# The citation marks, title and document-number patterns.
CITATION = r"\x{E200}(?:cite|filecite)\x{E202}.*?\x{E201}"
INVISIBLE = r"[\x{200B}\x{FEFF}]"
DATE_PREFIX = rf"^{BLANK}*(?:20[0-9]{{2}}[-/.年][0-9]{{1,2}}[-/.月][0-9]{{1,2}}日?{BLANK}*)"
DECORATION = rules.TITLE_PREFIX_PATTERN.replace(r"\s", BLANK)  # both engines read the published \s and \d alike only when spelled out
DOCUMENT_NUMBER = rf"(?:[\x{{4e00}}-\x{{9fa5}}]{{1,10}})?[〔\[]{BLANK}*(20[0-9]{{2}}){BLANK}*[〕\]]{BLANK}*[0-9]+{BLANK}*号"
PUNCTUATION = (
    r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
    r"\-—–_·•丨|｜:：;；,，。.!！?？'\"“”‘’()（）\[\]【】《》<>]+"
)
DATE_SEPARATED = r"(20[0-9]{2})[-/.年](1[0-2]|0?[1-9])[-/.月](3[01]|[12][0-9]|0?[1-9])日?"
DATE_COMPACT = r"(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])"
DATE_ISO = r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})(?:[T ][0-9:.,+Z-]*)?$"
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
QUANTITY = "(?i)" + rules.QUANTITY_PATTERN.replace(r"\s", BLANK).replace(r"\d", "[0-9]")
# End of fixed values.

# The same classes for Java, which tries the members of a class one by one: letters leave at the first ranges. RE2 has no "&&".
_NO_BLANK = r"\x{A1}-\x{167F}\x{3001}-\x{10FFFF}"
ANY_BLANK = rf"[[^\x{{21}}-\x{{84}}{_NO_BLANK}]&&{BLANK}]"
# Runs of blanks that are not one space already.
BLANK_RUN = rf"[[^\x{{20}}-\x{{84}}{_NO_BLANK}]&&{BLANK}]{ANY_BLANK}*+|\x{{20}}{ANY_BLANK}++"
ANY_PUNCTUATION = rf"[[^a-z\x{{C0}}-\x{{167F}}\x{{4E29}}-\x{{FEFF}}0-9A-Z]&&{PUNCTUATION[:-1]}]++"
# A date and the decoration behind it, each as it matches alone.
TITLE_START = f"^(?>{DATE_PREFIX[1:]})?+(?>{DECORATION[1:]})?+"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_text(*columns: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


def let(c: Column, body) -> Column:
    """``body`` over a value that is written once: keeps nested expressions from multiplying."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), BLANK_RUN, " "))


def unescape(c: Column) -> Column:
    """The common entities as characters, ampersand last."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def clean_text(c: Column) -> Column:
    text = text_or_empty(c)
    text = F.when(text.contains("\ue200"), F.regexp_replace(text, CITATION, "")).otherwise(text)
    for char in ("\u200b", "\ufeff"):
        text = F.replace(text, F.lit(char), F.lit(""))
    return collapse_space(text)


def clean_title(c: Column) -> Column:
    # Clean text has single spaces only, and the edge characters hold the space: nothing is left to collapse.
    return F.btrim(F.regexp_replace(clean_text(c), TITLE_START, ""), F.lit(rules.TITLE_EDGE_CHARS))


def normal_title(c: Column) -> Column:
    title = F.lower(clean_title(c))
    for token in rules.TITLE_TOKENS:
        title = F.replace(title, F.lit(token), F.lit(""))
    return F.regexp_replace(title, ANY_PUNCTUATION, "")


def document_number(*columns: Column) -> Column:
    # A number ends in this character; texts without it are not cleaned.
    number = lambda c: F.regexp_replace(F.regexp_extract(clean_text(c), DOCUMENT_NUMBER, 0), ANY_PUNCTUATION, "")
    return first_text(*[F.when(text_or_empty(c).contains("号"), number(c)).otherwise("") for c in columns])


def has_quantity(c: Column) -> Column:
    return c.rlike(QUANTITY)


def sha_hex(*columns: Column) -> Column:
    """SHA-256 over the texts joined by a bar; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[text_or_empty(c) for c in columns]), 256)


def event_key(title: Column, summary: Column, published: Column) -> Column:
    number = document_number(title, summary)
    day = F.substring(text_or_empty(published), 1, 10)
    by_title = F.concat(F.lit("EVT-"), F.substring(sha_hex(normal_title(title), day), 1, 16))
    by_number = F.concat(F.lit("DOC-"), F.substring(F.sha2(number, 256), 1, 16))
    return F.when(number != "", by_number).otherwise(by_title)


def _part(value: Column, group: int) -> Column:
    return F.regexp_extract(value, URL_PARTS, group)


def _requote(value: Column) -> Column:
    """Decode a form-encoded token and write it back in one canonical spelling."""
    stray = F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25")
    encoded = F.url_encode(F.coalesce(F.try_url_decode(stray), value))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(c: Column) -> Column:
    """HTTPS, lower-case host, single slashes, no tracking parameters, no fragment."""

    def upgraded(value: Column) -> Column:
        absolute = F.when(value.startswith("//"), F.concat(F.lit("https:"), value)).otherwise(value)
        return let(F.regexp_replace(absolute, "^http://", "https://"), spelled)

    def spelled(value: Column) -> Column:
        parts = F.struct(
            F.coalesce(blank_to_null(F.lower(_part(value, 1))), F.lit("https")).alias("scheme"),
            F.lower(_part(value, 2)).alias("host"),
            F.regexp_replace(F.regexp_replace(_part(value, 3), "/{2,}", "/"), "(?<=.)/$", "").alias("path"),
            _kept_query(_part(value, 4)).alias("query"),
        )
        return F.when(value == "", "").otherwise(let(parts, joined))

    def joined(p: Column) -> Column:
        hosted = (p["host"] != "") | p["scheme"].isin("http", "https")
        path = F.when((p["path"] == "") | (hosted & ~p["path"].startswith("/")), F.concat(F.lit("/"), p["path"])).otherwise(p["path"])
        authority = F.when(hosted, F.concat(F.lit("//"), p["host"])).otherwise("")
        tail = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
        return F.concat(p["scheme"], F.lit(":"), authority, path, tail)

    # Never null, so joins on the key add no null test that would compute it again.
    return F.coalesce(let(collapse_space(c), upgraded), F.lit(""))


def _kept_query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _requote(F.regexp_extract(p, "^([^=]*)", 1)).alias("name"),
            _requote(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(rules.TRACKING_PARAMS))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "&")


def url_host(c: Column) -> Column:
    """Host name without user or port, lower case."""
    return F.lower(F.regexp_extract(text_or_empty(c), r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_allowed(url: Column, domains: Column) -> Column:
    host = url_host(url)
    listed = F.exists(domains, lambda d: (host == d) | host.endswith(F.concat(F.lit("."), d)))
    return F.coalesce(F.size(domains) == 0, F.lit(True)) | listed


def _date_by(text: Column, pattern: str) -> Column:
    parts = [F.regexp_extract(text, pattern, i) for i in (1, 2, 3)]
    padded = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.try_to_date(F.when(parts[0] != "", padded), "yyyy-MM-dd")


def parse_date(c: Column, as_of: Column | None = None) -> Column:
    """Date found in free text. A missing date becomes ``as_of`` when one is given, else null."""
    patterns = (DATE_SEPARATED, DATE_COMPACT, DATE_ISO)
    found = let(collapse_space(c), lambda text: F.coalesce(*[_date_by(text, p) for p in patterns]))
    return F.coalesce(found, as_of.cast("date")) if as_of is not None else found


def first_date(*columns: Column, as_of: Column | None = None) -> Column:
    found = F.coalesce(*[parse_date(c) for c in columns])
    return F.coalesce(found, as_of.cast("date")) if as_of is not None else found


def lenient_double(c: Column, default: float | None = None) -> Column:
    """Number from text with commas; null, blank, bad, NaN and infinite values take the default."""
    value = F.replace(c.cast("string"), F.lit(","), F.lit("")).try_cast("double")
    return F.coalesce(let(value, _finite), F.lit(default).cast("double"))


def _finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lenient_int(c: Column, default: int | None = 0) -> Column:
    return F.coalesce(lenient_double(c).try_cast("int"), F.lit(default).cast("int"))


def is_true(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(rules.TRUE_WORDS), F.lit(False))


def board_number(c: Column, blank_is_zero: bool = False) -> Column:
    """Number as a form field reads it: no commas allowed; a blank is missing unless told otherwise."""
    text = F.trim(c.cast("string"))
    finite = let(text.try_cast("double"), _finite)
    return F.when(text == "", F.lit(0.0)).otherwise(finite) if blank_is_zero else finite


def split_list(c: Column) -> Column:
    parts = F.transform(F.split(text_or_empty(c), "[;；,]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")
