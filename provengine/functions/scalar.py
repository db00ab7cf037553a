"""Identity and scalar normalisation: plain functions from Column to Column, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "(?U)[\\s\\x1c-\\x1f]"

# Wrappers, closers and trailing characters of identifiers as people paste them.
WRAPPERS = {"<": ">", "(": ")", "[": "]", "{": "}", '"': '"', "'": "'"}
CLOSERS = {")": "(", "]": "[", "}": "{"}
TRAILING = ".,;:'\"<>"
DOI_PREFIX = "(?i)^(?:(?:https?://(?:dx\\.|www\\.)?doi\\.org/|(?:dx\\.)?doi\\.org/|info:doi/|doi:|doi/)\\s*)+"
DOI_SHAPE = "^10\\.[0-9]{4,9}/\\S+$"
SECRET_PARAMS = ("api_key", "apikey", "key", "token", "access_token", "email")
PMC_HOSTS = ("pmc.ncbi.nlm.nih.gov", "www.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "europepmc.org", "www.europepmc.org")
PMCID = "(?i)(?:^|/|=)(PMC[0-9]+)(?:$|[/?&.])"
LOCAL_NAMES = ("localhost", "localhost.localdomain", "ip6-localhost")
# Literal addresses that no fetch may reach (private, loopback, link-local, reserved, multicast).
CLOSED_V4 = (
    "^(?:(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5])\\.[0-9]+\\.[0-9]+\\.[0-9]+"
    "|169\\.254\\.[0-9]+\\.[0-9]+|172\\.(?:1[6-9]|2[0-9]|3[01])\\.[0-9]+\\.[0-9]+|192\\.168\\.[0-9]+\\.[0-9]+"
    "|192\\.0\\.0\\.(?!(?:9|10)$)[0-9]+|192\\.0\\.2\\.[0-9]+|198\\.1[89]\\.[0-9]+\\.[0-9]+|198\\.51\\.100\\.[0-9]+|203\\.0\\.113\\.[0-9]+)$"
)
# Of IPv6, by its 32 digits: all but 2000::/3 and fec0::/10, and in the former 2001::/23 (with exceptions), 2001:db8::/32, 2002::/16 and 3fff::/20.
OPEN_V6 = "^(?:2001000100000000000000000000000[12]|20010003|200100040112|2001002|2001003)"
CLOSED_V6 = "^(?:[0-14-9a-e]|f(?!e[c-f])|2001(?:0[01]|0db8)|2002|3fff0)"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col) -> Column:
    return F.regexp_replace(_c(col), f"^{SPACE}+|{SPACE}+$", "")


def _fold(times: Column, start: Column, step) -> Column:
    """Apply `step` to `start` as often as `times` says; a fixed point stays."""
    return F.aggregate(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")), start, lambda v, _: step(v))


def _count(value: Column, char: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(char), F.lit("")))


def normalize_doi(col) -> Column:
    """Canonical DOI or NULL: wrappers and URL prefixes off, trailing artefacts off, lower case."""
    value = strip(col)

    def peel(v: Column) -> Column:
        wrapped = F.concat(F.left(v, F.lit(1)), F.right(v, F.lit(1))).isin(*[a + b for a, b in WRAPPERS.items()])
        return F.when(wrapped & (F.length(v) >= 2), strip(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v)

    openers = F.length(F.regexp_extract(value, "^[<(\\[{\"'\\s]*", 0))
    value = F.when(openers > 0, _fold(openers, value, peel)).otherwise(value)
    value = strip(F.regexp_replace(value, DOI_PREFIX, ""))

    def trim_end(v: Column) -> Column:
        last = F.right(v, F.lit(1))
        drop = F.lit(TRAILING).contains(last) & (last != "")
        for closer, opener in CLOSERS.items():
            drop = drop | ((last == closer) & (_count(v, opener) < _count(v, closer)))
        return F.when(drop, F.left(v, F.length(v) - 1)).otherwise(v)

    tail = F.length(F.regexp_extract(value, "[.,;:'\"<>)\\]}]*$", 0))
    value = strip(F.when(tail > 0, _fold(tail, value, trim_end)).otherwise(value))
    value = F.lower(value)
    return F.when(value.rlike(DOI_SHAPE), value)


def is_valid_doi(col) -> Column:
    return normalize_doi(col).isNotNull()


def slugify(col) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _id(prefix: Column, name: Column, key: Column) -> Column:
    slug = F.regexp_replace(F.left(slugify(name), F.lit(100)), "^_+|_+$", "")
    return F.concat(prefix, F.lit("_"), slug, F.lit("_"), F.left(F.sha2(key, 256), F.lit(12)))


def document_id_for_doi(doi) -> Column:
    """From a canonical DOI."""
    return _id(F.lit("doi"), _c(doi), _c(doi))


def document_id_for_source(source, source_id) -> Column:
    """Fallback for works without a DOI; NULL where either part gives an empty slug."""
    source, source_id = _c(source), _c(source_id)
    made = _id(slugify(source), source_id, F.concat(source, F.lit(":"), source_id))
    return F.when((slugify(source) != "") & (slugify(source_id) != ""), made)


def assign_identity(df: DataFrame, doi: str = "doi", source: str = "provider", source_id: str = "source_id") -> DataFrame:
    """Add document_id: from the DOI where there is one, else from the source's own id."""
    return df.withColumn("document_id", F.when(F.col(doi).isNotNull(), document_id_for_doi(doi)).otherwise(document_id_for_source(source, source_id)))


def is_safe_document_id(col) -> Column:
    return F.coalesce(_c(col).rlike("^[a-z0-9][a-z0-9_]{0,199}$"), F.lit(False))


def pmcid_from_urls(urls) -> Column:
    """The one PMCID that URLs on known hosts name; NULL if none or several."""
    known = F.filter(_c(urls), lambda u: F.lower(F.try_parse_url(u, F.lit("HOST"))).isin(*PMC_HOSTS))
    found = F.flatten(
        F.flatten(
            F.transform(
                known,
                lambda u: F.array(
                    *[F.coalesce(F.regexp_extract_all(F.try_parse_url(u, F.lit(part)), F.lit(PMCID), F.lit(1)), F.array().cast("array<string>")) for part in ("PATH", "QUERY")]
                ),
            )
        )
    )
    distinct = F.array_distinct(F.transform(found, F.upper))
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def _dotted(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)])


def v4_address(host: Column) -> Column:
    """The dotted form of an IPv4 address in any numeric form (one to four parts, decimal, hexadecimal or octal); else NULL."""
    parts = F.split(host, "\\.")
    number = lambda p: (
        F.when(p.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(p, 3, 8), 16, 10)).when(p.rlike("^0[0-7]{0,11}$"), F.conv(p, 8, 10)).when(p.rlike("^[1-9][0-9]{0,9}$"), p).try_cast("long")
    )
    n, size = F.transform(parts, number), F.size(parts)
    last, total = F.get(n, size - 1), F.lit(0).cast("long")
    for k in range(3):
        total = total + F.when(F.lit(k) < size - 1, F.shiftleft(F.get(n, F.lit(k)), 24 - 8 * k)).otherwise(0)
    fits = (size <= 4) & F.forall(n, lambda x: x.isNotNull()) & F.forall(F.slice(n, 1, F.greatest(size - 1, F.lit(0))), lambda x: x < 256)
    return F.when(fits & (last < F.pow(F.lit(256), 5 - size)), _dotted(total + last))


def v6_digits(host: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address in any form; else NULL."""
    tail = F.regexp_extract(host, ":([0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+)$", 1)
    octets = F.array_join(F.transform(F.split(tail, "\\."), lambda o: F.lpad(F.lower(F.hex(o.try_cast("long"))), 2, "0")), "")
    head = F.substring(host, F.lit(1), F.length(host) - F.length(tail))
    plain = F.regexp_replace(F.when(tail == "", host).otherwise(F.concat(head, F.substring(octets, 1, 4), F.lit(":"), F.substring(octets, 5, 4))), "%.*$", "")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    short = plain.contains("::")
    left, right = groups(F.substring_index(plain, "::", 1)), groups(F.when(short, F.substring_index(plain, "::", -1)).otherwise(""))
    filled = F.concat(left, F.when(short, F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))).otherwise(F.array().cast("array<string>")), right)
    digits = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    return F.when(plain.rlike("^[0-9a-f:]*:[0-9a-f:]*$") & ~plain.rlike("[0-9a-f]{5}|::.*::|:::") & digits.rlike("^[0-9a-f]{32}$"), digits)


def is_closed_host(host: Column) -> Column:
    """A local name, or a literal address in any form that isn't public. Names aren't resolved."""
    six, four = v6_digits(host), v4_address(host)
    mapped = six.startswith("0" * 20 + "ffff")
    inner = _dotted(F.conv(F.substring(six, 25, 8), 16, 10).cast("long"))
    closed = F.when(mapped, inner.rlike(CLOSED_V4)).when(six.isNotNull(), six.rlike(CLOSED_V6) & ~six.rlike(OPEN_V6)).when(four.isNotNull(), four.rlike(CLOSED_V4))
    return host.isin(*LOCAL_NAMES) | F.coalesce(closed, F.lit(False))


def url_safety(col) -> Column:
    """'ok' or why a remote URL must not be fetched."""
    url = _c(col)
    host = F.lower(F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)", 1), "^\\[|\\]$", ""))
    return (
        F.when(url.isNull() | (url == ""), "empty")
        .when((strip(url) != url) | url.rlike("[\\n\\r\\t]"), "whitespace")
        .when(~F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)).isin("http", "https"), "scheme")
        .when(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1).contains("@"), "credentials")
        .when(host == "", "no host")
        .when(is_closed_host(host), "private target")
        .otherwise("ok")
    )


def redact_url(col) -> Column:
    """Values of secret parameters masked, user information dropped, the query encoded anew."""
    url = F.regexp_replace(_c(col), "^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#]*@", "$1")
    base, query, tail = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    encode = lambda v: F.replace(F.replace(F.url_encode(v), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    decode = lambda v: F.coalesce(F.try_url_decode(v), v)

    def pair(p: Column) -> Column:
        key, value = F.substring_index(p, "=", 1), F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise("")
        hidden = F.lower(decode(key)).isin(*SECRET_PARAMS) & (value != "")
        return F.concat(encode(decode(key)), F.lit("="), F.when(hidden, F.lit("REDACTED")).otherwise(encode(decode(value))))

    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.when(query == "", F.concat(base, tail)).otherwise(F.concat(base, F.lit("?"), F.array_join(F.transform(pairs, pair), "&"), tail))


# What is masked in any text, and by what.
SCRUBBED = (
    ("(?i)((?:api_key|apikey|access_token|token|key)=)([^&\\s\"']+)", "$1REDACTED"),
    ("(?i)(email=)([^&\\s\"']+)", "$1REDACTED"),
    ("(?i)(mailto:)([^\\s\"'<>)]+)", "$1REDACTED"),
    ("(?U)\\b[\\w.+-]+@[\\w-]+\\.[\\w.-]+\\b", "REDACTED"),
)


def scrub(col) -> Column:
    """Mask secrets and addresses in any text."""
    out = _c(col)
    for pattern, mask in SCRUBBED:
        out = F.regexp_replace(out, pattern, mask)
    return out


def scrub_nested(df: DataFrame, keys: tuple[str, ...] = SECRET_PARAMS, secrets: tuple[str, ...] = ()) -> DataFrame:
    """Mask, at any depth, values under secret names and configured secrets: the schema is walked when the plan is made."""
    names = {k.lower() for k in keys}

    def walk(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType):
            for s in secrets:
                value = F.replace(value, F.lit(s), F.lit("REDACTED"))
            return value
        if isinstance(kind, T.StructType):
            fields = [field(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: walk(x, kind.elementType))
        if isinstance(kind, T.MapType):
            hide = F.lower
            return F.transform_values(value, lambda k, v: F.when(hide(k).isin(*names) & v.isNotNull(), F.lit("REDACTED").cast(kind.valueType) if isinstance(kind.valueType, T.StringType) else F.lit(None)).otherwise(walk(v, kind.valueType)))
        return value

    def field(value: Column, kind: T.DataType, name: str) -> Column:
        if name.lower() in names:
            return F.when(value.isNotNull(), F.lit("REDACTED")) if isinstance(kind, T.StringType) else F.lit(None).cast(kind)
        return walk(value, kind)

    return df.select(*[field(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def mask_secret(col, kind: str) -> Column:
    """A hint that names a secret without giving it away."""
    value = _c(col)
    if kind == "email":
        local, domain = F.substring_index(value, "@", 1), F.substring(value, F.instr(value, "@") + 1, F.length(value))
        stars = F.repeat(F.lit("*"), F.greatest(F.lit(3), F.length(local) - 1))
        hint = F.when(value.contains("@") & (domain != ""), F.concat(F.left(local, F.lit(1)), stars, F.lit("@"), domain)).otherwise("***")
    else:
        hint = F.concat(F.lit("*" * 8), F.when(F.length(value) > 8, F.right(value, F.lit(4))).otherwise(""))
    return F.when(value.isNotNull() & (value != ""), hint)


def clean_text(col) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_c(col), f"{SPACE}+", " ")), F.lit(""))


def coerce_int(col) -> Column:
    """An integer from text; NULL if it is none."""
    text = strip(_c(col).cast("string"))
    return F.when(text.rlike("^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("long"))


def yes_no(col) -> Column:
    return F.when(_c(col) == "Y", True).when(_c(col) == "N", False)


def short_id(col) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(col), "/+$", ""), "/"), -1)


def canonical_json(value: Column, kind: T.StructType) -> Column:
    """JSON with sorted names, no spaces, nulls kept."""

    def ordered(v: Column, k: T.DataType) -> Column:
        if isinstance(k, T.StructType):
            return F.struct(*[ordered(v[f.name], f.dataType).alias(f.name) for f in sorted(k.fields, key=lambda f: f.name)])
        if isinstance(k, T.ArrayType):
            return F.transform(v, lambda x: ordered(x, k.elementType))
        return v

    return F.to_json(ordered(value, kind), {"ignoreNullFields": "false"})


def canonical_sha(df: DataFrame, columns: list[str]) -> Column:
    kind = T.StructType([df.schema[c] for c in columns])
    return F.sha2(canonical_json(F.struct(*columns), kind), 256)


def norm_cmp(col) -> Column:
    """For comparing values: white space collapsed, case folded, trailing full stops dropped."""
    return F.regexp_replace(F.replace(F.lower(clean_text(col)), F.lit("ß"), F.lit("ss")), "\\.+$", "")


