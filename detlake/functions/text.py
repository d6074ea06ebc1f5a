"""Text, identity and message predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DIGEST = "^[a-f0-9]{64}$"
MESSAGE_LIMIT = 1024


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def is_digest(value) -> Column:
    return F.coalesce(_c(value).rlike(DIGEST), F.lit(False))


def stable_id(kind: str, *parts) -> Column:
    """``kind-<sha256>`` of the parts, written as a JSON array in the given order."""
    return F.concat(
        F.lit(kind + "-"),
        F.sha2(F.to_json(F.array(*[_c(p).cast("string") for p in parts])), 256),
    )


def canonical_json(**fields) -> Column:
    """JSON of named fields in alphabetical order, so equal records give equal text."""
    return F.to_json(F.struct(*[_c(fields[n]).alias(n) for n in sorted(fields)]))


def record_digest(**fields) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def sorted_entries(mapping) -> Column:
    """A map as an array ordered by key: maps have no order of their own."""
    return F.array_sort(F.map_entries(mapping))


def json_equal(a, b) -> Column:
    """Whether two JSON texts hold equal values: order of keys does not count, 1 equals 1.0 and 1e0,
    but true is not 1 and "1" is not 1. Null if either is no JSON."""
    return json_canonical(a) == json_canonical(b)


def json_canonical(text) -> Column:
    """JSON with sorted keys and one spelling for each number, or null if it is no JSON.

    ``parse_json`` sorts keys and refuses repeated ones. A number with a fraction or an exponent
    counts as the double nearest to it; one of digits alone is compared digit by digit.
    """
    plain = F.to_json(F.try_parse_json(_c(text)))
    parts = F.regexp_extract_all(plain, F.lit(_JSON_PART), F.lit(0))
    return F.when(plain.isNotNull(), F.array_join(F.transform(parts, _one_spelling), ""))


# A whole string, a number, or what stands between them.
_JSON_PART = r'"(?:[^"\\]|\\.)*"|-?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?|[^"0-9-]+|-'


def _one_spelling(part: Column) -> Column:
    """A number's one spelling: digits alone if it is whole, else those of its double."""
    double = part.try_cast("double")
    whole = (double == F.floor(double)) & (F.abs(double) < 1e37)
    digits = F.when(part.rlike("^-?[0-9]+$"), F.regexp_replace(part, "^-0$", "0")).when(
        whole, double.try_cast("decimal(38,0)").cast("string")
    )
    return F.when(part.rlike("^-?[0-9]"), F.coalesce(digits, double.cast("string"))).otherwise(part)


def batch_hash() -> Column:
    """Identity of a review batch read from JSON."""
    decisions = F.transform(
        "decisions",
        lambda d: F.struct(
            sorted_entries(d["answers"]).alias("answers"),
            d["case_id"].alias("case_id"),
            d["rationale"].alias("rationale"),
        ),
    )
    return record_digest(
        decisions=decisions,
        packet_sha256="packet_sha256",
        reviewed_at="reviewed_at",
        reviewer="reviewer",
        schema_version="schema_version",
    )


def hamming(a, b) -> Column:
    return F.bit_count(_c(a).bitwiseXOR(_c(b)))


def closest_variant(one, variants) -> Column:
    """Smallest distance from one signature to any of another image's variants."""
    return F.array_min(F.transform(_c(variants), lambda v: F.bit_count(_c(one).bitwiseXOR(v))))


def source_family(name, rule: str) -> Column:
    """Family of an image from its name.

    ``numbered``: the leading number of ``12-3-4.png``; ``export``: the part before
    ``.rf.``; ``board``: the first ``10e…`` or ``TL<digits>`` token. No match is NULL for
    ``numbered`` (an error to the caller) and ``unresolved`` for ``board``.
    """
    text = _c(name)
    if rule == "numbered":
        found = F.regexp_extract(text, r"^(\d+)-\d+-\d+\.png$", 1)
        return F.when(found != "", found)
    if rule == "export":
        return F.split_part(F.element_at(F.split(text, "/"), -1), F.lit(".rf."), F.lit(1))
    if rule == "board":
        found = F.regexp_extract(text, r"(10e[^_]+|TL\d+)", 1)
        return F.when(found != "", found).otherwise("unresolved")
    raise ValueError(f"unknown family rule {rule}")


def pair_key(file, suffix: str = "_Cur.jpg") -> Column:
    text = _c(file)
    stem = F.substring(text, F.lit(1), F.length(text) - len(suffix))
    return F.when(text.endswith(suffix), stem).otherwise(text)


def safe_path(path) -> Column:
    """Relative, without parent steps or backslashes, and naming something."""
    text = _c(path)
    unsafe = (
        text.isNull()
        | (F.trim(text) == "")
        | text.startswith("/")
        | text.rlike(r"(^|/)\.\.(/|$)")
        | text.contains("\\")
        | text.rlike(r"^\.?/*$")
    )
    return ~F.coalesce(unsafe, F.lit(True))


def bounded_text(value, limit: int) -> Column:
    text = _c(value)
    return F.coalesce((F.length(F.trim(text)) > 0) & (F.length(text) <= limit), F.lit(False))


def zoned_timestamp(value) -> Column:
    """Timestamp of an ISO text that states its zone, else NULL."""
    text = _c(value)
    zoned = text.endswith("Z") | text.rlike(r"[+-]\d\d:?\d\d$")
    return F.when(zoned, F.try_to_timestamp(text))


def message_issue(body) -> Column:
    """Why a queue message cannot be used, NULL when it can."""
    text = _c(body)
    document = F.try_parse_json(text)
    fields = F.from_json(text, "event_id string, inspection_id string")
    keys = F.array_sort(F.json_object_keys(text))
    expected = F.array(F.lit("event_id"), F.lit("inspection_id"), F.lit("version"))
    version = F.try_variant_get(document, "$.version", "variant")
    first = F.schema_of_variant(version).eqNullSafe("BIGINT") & F.try_variant_get(
        document, "$.version", "bigint"
    ).eqNullSafe(F.lit(1))

    def canonical_uuid(name: str) -> Column:
        return F.coalesce(fields[name].rlike(UUID), F.lit(False))

    return (
        F.when(F.length(text) > MESSAGE_LIMIT, "oversized")
        .when(document.isNull() | keys.isNull(), "not_an_object")
        .when(~keys.eqNullSafe(expected), "unexpected_keys")
        .when(~first, "unsupported_version")
        .when(~(canonical_uuid("event_id") & canonical_uuid("inspection_id")), "invalid_identity")
    )
