"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What digests and fingerprints begin with, unless their parameter names the preamble of a system to be compared with.
DIGEST_PREAMBLE = "recordloom/record-digest/v1"
FINGERPRINT_PREAMBLE = "recordloom/schema-fingerprint/v1"
#: Fixed values of the formats.
ID_PREFIX = "kweb:v1"
BOOK_NAMESPACE = "34a87ea1-f0e4-4f4d-8894-1de178aa7a3e"
ENTITY_KINDS = ["entry", "part_of_speech", "common_pattern", "sense"]
UNIT_KINDS = {"어휘": "entry", "품사": "part_of_speech", "공통 문형": "common_pattern", "의미": "sense"}
DICTIONARIES = ["krdict", "stdict", "opendict"]
FILE_PREFIXES = {"krdict": "01-한국어기초사전", "stdict": "02-표준국어대사전", "opendict": "03-우리말샘"}
ENTRY_ELEMENTS = {"krdict": "LexicalEntry", "stdict": "item", "opendict": "item"}
CONTROLS = [c for c in range(32) if c not in (9, 10, 13)]
ESCAPES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&apos;"}
SEMANTIC = {
    "semantic-headword": ["word", "headword", "lemma"],
    "semantic-definition": ["definition", "definition_original", "sense"],
    "semantic-example": ["example", "example_info", "exampleinfo"],
    "semantic-translation": ["translation", "translation_info", "translationinfo"],
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_u(x: Column | str) -> Column:
    """Strip Unicode white space at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def key_or_null(x: Column | str) -> Column:
    """A usable key: trimmed, null if empty."""
    return F.nullif(trim_u(x), F.lit(""))


def local_name(x: Column | str) -> Column:
    return F.substring_index(_col(x), ":", -1)


def control_count(x: Column | str) -> Column:
    return F.regexp_count(_col(x), F.lit("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")).cast("bigint")


def sanitize(x: Column | str) -> Column:
    """Double U+E000, then write each forbidden control c as U+E000 U+(E010 + c)."""
    out = F.replace(_col(x), F.lit("\uE000"), F.lit("\uE000\uE000"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(chr(c)), F.lit("\uE000" + chr(0xE010 + c)))
    return out


def restore(x: Column | str) -> Column:
    """The inverse of sanitize(); an escape that sanitize() doesn't write is an error. Between doubled marks, each mark
    begins a control's escape."""

    def back(piece: Column) -> Column:
        for c in CONTROLS:
            piece = F.replace(piece, F.lit("\uE000" + chr(0xE010 + c)), F.lit(chr(c)))
        return F.when(F.contains(piece, F.lit("\uE000")), F.raise_error(F.lit("invalid control escape"))).otherwise(piece)

    return F.array_join(F.transform(F.split(_col(x), "\uE000\uE000", -1), back), "\uE000")


def escape_xml(x: Column | str) -> Column:
    out = _col(x)
    for raw, name in ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def render_value(x: Column | str) -> Column:
    """escape_xml, with each forbidden control as a marked span. Values without one skip the replacements."""
    plain = escape_xml(x)
    out = plain
    for c in CONTROLS:
        out = F.replace(out, F.lit(chr(c)), F.lit(f'<span class="xml-control" data-codepoint="U+{c:04X}">{chr(0x2400 + c)} U+{c:04X}</span>'))
    return F.when(_col(x).rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"), out).otherwise(plain)


def semantic_class(name: Column | str, attributes: Column | str) -> Column:
    local = local_name(name)
    written = F.exists(_col(attributes), lambda a: (a["name"] == "att") & (a["value"] == "writtenForm"))
    out = F.when((local == "feat") & written, "semantic-headword")
    for label, names in SEMANTIC.items():
        out = out.when(F.lower(local).isin(*names), label)
    return out


def percent_encode(x: Column | str) -> Column:
    """RFC 3986: all but unreserved bytes as upper-case hex."""
    out = F.url_encode(_col(x))
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical_id(commit: str, dictionary: Column, kind: Column, key: Column, occurrences: Column, owner: Column, locator: Column) -> Column:
    """An entry's id under the commit, any other's under its owner; with the locator unless the key occurs exactly once."""
    named = F.coalesce(percent_encode(key_or_null(key)), F.lit("missing"))
    base = F.when(kind == "entry", F.concat(F.lit(f"{ID_PREFIX}/"), percent_encode(F.lit(commit)), F.lit("/"), dictionary, F.lit("/entry/"), named)).otherwise(F.concat(owner, F.lit("/"), kind, F.lit("/"), named))
    return F.when(occurrences == 1, base).otherwise(F.concat(base, F.lit("/at/"), percent_encode(locator)))


def url_host(x: Column | str) -> Column:
    """Lower-case host without user and port; null without ://."""
    url = trim_u(x)
    host = F.regexp_extract(F.regexp_replace(url, r"(?s)^.*?://", ""), r"^[^/?#]*", 0)
    host = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def url_query(x: Column | str, name: str) -> Column:
    """The last value of a query name, any fragment included; null if it is missing or there is no ://."""
    url = trim_u(x)
    query = F.when((F.instr(url, "://") > 0) & (F.instr(url, "?") > 0), F.regexp_replace(url, r"(?s)^[^?]*\?", ""))
    found = F.filter(F.split(query, "&", -1), lambda p: F.substring_index(p, "=", 1) == name)
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.instr(last, "=") > 0, F.regexp_replace(last, r"(?s)^[^=]*=", "")).when(last.isNotNull(), "")


def labels_compatible(word: Column | str, headword: Column | str) -> Column:
    """Equal after trimming, or the word is the headword and exactly two or three digits."""
    w, h = trim_u(word), trim_u(headword)
    digits = F.length(F.regexp_extract(w, "([0-9]*)$", 1))
    return (w == h) | (digits.isin(2, 3) & (F.left(w, F.length(w) - digits) == h))


def single(values: Column | str) -> Column:
    v = _col(values)
    return F.when(F.size(v) == 1, F.get(v, F.lit(0)))


def target_kinds(dictionary: Column | str, units: Column | str) -> Column:
    unit = trim_u(single(units))
    out = F.when(_col(dictionary) != "stdict", F.array(F.lit("entry")))
    for name, kind in UNIT_KINDS.items():
        out = out.when(unit == name, F.array(F.lit(kind)))
    return out.otherwise(F.array(*[F.lit(k) for k in ENTITY_KINDS]))


def locator(dictionary: Column, path: Column, entry: Column, pos: Column | None = None, pattern: Column | None = None, sense: Column | None = None) -> Column:
    parts = [dictionary, F.lit(":"), path, F.lit("#entry="), entry.cast("string")]
    for name, x in (("pos", pos), ("pattern", pattern), ("sense", sense)):
        if x is not None:
            parts.append(F.coalesce(F.concat(F.lit(f"/{name}="), x.cast("string")), F.lit("")))
    return F.concat(*parts)


def uuid5(namespace: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def numeric_key(x: Column | str) -> Column:
    """The key as an unsigned 64-bit number; null if it is none."""
    k = _col(x)
    n = F.when(k.rlike(r"^\+?[0-9]{1,37}$"), k.cast("decimal(38,0)"))
    return F.when(n <= F.lit("18446744073709551615").cast("decimal(38,0)"), n)
