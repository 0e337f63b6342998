"""Text signals, n-gram overlap, bit-string similarity, drift, public projection."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.functions.columns import hex_to_long, is_true, quarter_label

# Wording that signals hindsight or an outside source.
RETROSPECTIVE = (
    r"\bas we now know\b",
    r"\bturned out\b",
    r"\bwent on to\b",
    r"\b(?:subsequently|later|eventually)\s+(?:rose|fell|rallied|crashed|increased|decreased)\b",
    r"\bhas since\s+(?:risen|fallen|rallied|crashed|increased|decreased)\b",
)
UNSUPPORTED_SOURCE = (
    r"\baccording to\s+(?:news|reports?|announcements?|regulatory filings?)\b",
    r"\b(?:news|media) reports?\b",
    r"\b(?:earnings release|regulatory filing|press release)\b",
)


def matches_any(text: Column, patterns: Sequence[str]) -> Column:
    return is_true(text.rlike("(?i)(?:" + "|".join(patterns) + ")"))


def flags_text(flags: Column) -> Column:
    """A JSON list as words; anything else as it is."""
    listed = F.array_join(F.from_json(flags, "array<string>"), " ")
    return F.coalesce(listed, flags, F.lit(""))


def text_signals(df: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce(F.col("rationale"), F.lit("")), flags_text(F.col("risk_flags")))
    return df.withColumns(
        {
            "explicit_retrospective_signal": matches_any(text, RETROSPECTIVE),
            "unsupported_external_source_signal": matches_any(text, UNSUPPORTED_SOURCE),
            "calendar_quarter": quarter_label(F.col("decision_timestamp")),
            "active_proposal": ~is_true(F.col("action") == "abstain"),
            "absolute_expected_edge_bps": F.abs("expected_edge_bps"),
        }
    )


# Token, number and markup patterns.
TOKEN = r"[a-z0-9]+(?:-[a-z0-9]+)?"
NUMBER = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
MARKUP = (
    r"\\(?:cite\w*|ref|label|input|includegraphics|begin|end|section\*?|subsection\*?|paragraph"
    r"|caption|textbf|emph|texttt)(?:\[[^\]]*\])?\{[^{}]*\}"
)
COMMAND = r"\\[A-Za-z@]+\*?(?:\[[^\]]*\])?"
SYMBOLS = r"[`*_{}$&^~#|>]"


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text after comments and markup are removed.

    Each round removes the innermost commands.  A text takes as many rounds as its
    braces are deep, or as it has commands, if fewer; then none is left.
    """
    plain = F.regexp_replace(text, r"(?m)^\s*%.*$", " ")
    braces = F.regexp_extract_all(plain, F.lit("[{}]"), 0)
    depth = F.aggregate(
        braces, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda seen, brace: F.when(
            brace == "{",
            F.struct((seen["now"] + 1).alias("now"), F.greatest(seen["most"], seen["now"] + 1).alias("most")),
        ).otherwise(F.struct(F.greatest(seen["now"] - 1, F.lit(0)).alias("now"), seen["most"].alias("most"))),
        lambda seen: seen["most"],
    )
    rounds = F.least(depth, F.regexp_count(plain, F.lit(r"\\[A-Za-z]+")))
    stripped = F.aggregate(
        F.array_repeat(F.lit(1), rounds), plain, lambda left, _: F.regexp_replace(left, MARKUP, " ")
    )
    plain = F.when(text.contains("\\") & text.contains("{"), stripped).otherwise(plain)
    plain = F.regexp_replace(F.regexp_replace(plain, COMMAND, " "), SYMBOLS, " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(TOKEN), 0)


def ngrams(tokenised: Column, n: int) -> Column:
    size = F.size(tokenised)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))),
        lambda i: F.array_join(F.slice(tokenised, i, n), " "),
    )
    return F.when(size >= n, windows).otherwise(F.array().cast("array<string>"))


def ngram_rows(df: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """(n, ngram), one row per occurrence."""
    per_size = F.array(
        *[F.struct(F.lit(n).alias("n"), ngrams(F.col("_t"), n).alias("grams")) for n in sizes]
    )
    return (
        df.select(tokens(F.col(text)).alias("_t"))
        .select(F.inline(per_size))
        .select("n", F.explode("grams").alias("ngram"))
    )


def ngram_counts(df: DataFrame, text: str, sizes: Sequence[int], wanted: DataFrame | None = None) -> DataFrame:
    """(n, ngram, occurrences) of a corpus; a frequent n-gram is combined map-side.  With
    `wanted` (n, ngram) only these are counted: a small table of them is broadcast by
    AQE or by its size, and the others are never moved."""
    rows = ngram_rows(df, text, sizes)
    if wanted is not None:
        rows = rows.join(wanted.select("n", "ngram"), ["n", "ngram"], "left_semi")
    return rows.groupBy("n", "ngram").agg(F.count("*").alias("occurrences"))


def ngram_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Unique, shared and rates both ways per n, from (n, ngram) of two corpora, repeated or
    not.  An n-gram is moved once, as the 128 bits of its md5."""
    def side(df: DataFrame, bit: int) -> DataFrame:
        return df.select("n", F.unhex(F.md5("ngram")).alias("_g"), F.lit(bit).alias("_s"))

    sides = side(left, 1).unionByName(side(right, 2)).groupBy("n", "_g").agg(F.bit_or("_s").alias("_s"))
    sides = sides.select(
        "n", F.col("_s").bitwiseAND(F.lit(1)).alias("_l"), F.shiftright("_s", 1).alias("_r")
    )
    shared = F.sum(F.col("_l") * F.col("_r"))
    return sides.groupBy("n").agg(
        F.sum("_l").alias("left_unique"),
        F.sum("_r").alias("right_unique"),
        shared.alias("shared_unique"),
        (shared / F.greatest(F.sum("_l"), F.lit(1))).alias("left_rate"),
        (shared / F.greatest(F.sum("_r"), F.lit(1))).alias("right_rate"),
    )


def shared_examples(left: DataFrame, right: DataFrame, limit: int = 30) -> DataFrame:
    """Top shared n-grams by the smaller count; a top-k report."""
    both = left.withColumnRenamed("occurrences", "_a").join(
        right.withColumnRenamed("occurrences", "_b"), ["n", "ngram"]
    )
    scored = both.select("n", "ngram", F.least("_a", "_b").alias("common"))
    return scored.orderBy(F.desc("common"), F.desc("ngram"), "n").limit(limit)


def numbers(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(NUMBER), 0)).alias("number")).distinct()


# Spellings of a seed in configuration and code.
SEED_PATTERNS = (
    r"(?i)\b[a-z0-9_]*seed\s*[:=]\s*(\d{1,12})\b",
    r"(?i)\brandom_state\s*=\s*(\d{1,12})\b",
    r"(?i)\bdefault_rng\(\s*(\d{1,12})\s*\)",
    r"(?i)\bseed\s*=\s*[^,)]*?default\s*=\s*(\d{1,12})\b",
)


#: A line that lists seeds, and the numbers on it.
SEED_LINE, LISTED = r"(?i)\bseeds\s*:", r"\b(\d{1,12})\b"
LINE_END = "[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def seed_numbers(df: DataFrame, text: str) -> DataFrame:
    """Distinct seeds a text names: literals, numbers on a line that lists `seeds:`, and the
    whole numbers of the map `seeds` of a JSON object.  Numbers that JSON writes as text,
    with a fraction or beyond 64 bits are no seeds; broken JSON counts as plain text."""
    plain = F.flatten(
        F.array(*[F.regexp_extract_all(F.col(text), F.lit(p), 1) for p in SEED_PATTERNS])
    )
    lines = F.filter(F.split(F.col(text), LINE_END), lambda line: line.rlike(SEED_LINE))
    listed = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(line, F.lit(LISTED), 1)))
    found = df.select(F.explode(F.concat(plain, listed)).alias("s")).select(F.col("s").cast("bigint").alias("seed"))
    # Only a text that mentions the map is parsed.
    maps = df.filter(F.col(text).contains('"seeds"')).select(
        F.try_parse_json(F.ltrim(F.col(text))).alias("_j")
    ).filter(F.col("_j").isNotNull()).select(F.try_variant_get("_j", "$.seeds", "map<string,variant>").alias("_m"))
    mapped = maps.select(F.explode(F.map_values("_m")).alias("_v")).filter(
        F.schema_of_variant("_v") == "BIGINT"
    ).select(F.try_variant_get("_v", "$", "bigint").alias("seed"))
    return found.unionByName(mapped).distinct()


BITS = 64


def bit_signature(df: DataFrame, key: str, text: str) -> DataFrame:
    """64-bit signature of each text: bit i is set where set hash bits of the
    distinct tokens are at least half.  Distinct tokens are combined per text."""
    toks = df.select(key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("_t"))
    hashed = toks.select(
        key,
        hex_to_long(F.substring(F.md5("_t"), 1, 8)).alias("_h"),
        hex_to_long(F.substring(F.md5("_t"), 9, 8)).alias("_l"),
    )

    def vote(word: str, i: int) -> Column:
        return F.sum(F.shiftright(F.col(word), i).bitwiseAND(F.lit(1)))

    n = F.count("*")
    half = BITS // 2

    def packed(word: str) -> Column:
        total = F.lit(0).cast("bigint")
        for i in range(half):
            total = total + F.when(vote(word, i) * 2 >= n, F.lit(1 << i)).otherwise(F.lit(0))
        return total

    return hashed.groupBy(key).agg(packed("_h").alias("hi"), packed("_l").alias("lo"))


def similar_bits(
    left: DataFrame, right: DataFrame, minimum: float = 0.92, bands: int = 8
) -> DataFrame:
    """Distinct signatures of two corpora that agree on at least `minimum` of their
    bits, with the number of texts behind each.

    With d allowed differences, d + 1 .. bands: at least `bands - d` bands are
    untouched, so some choice of that many bands matches exactly.  Copies collapse
    into one signature before the join; a pair is reported by its first choice.
    """
    allowed = int(BITS * (1.0 - minimum) + 1e-9)
    if allowed >= bands:
        raise ValueError("more bands than allowed differences are needed")
    width = BITS // bands
    mask = (1 << width) - 1
    choices = list(combinations(range(bands), bands - allowed))
    up_to = {sum(1 << i for i in c): (1 << (c[-1] + 1)) - 1 for c in choices}

    def band(hi: Column, lo: Column, i: int) -> Column:
        word, shift = (hi, i * width) if i * width < 32 else (lo, i * width - 32)
        return F.shiftright(word, shift).bitwiseAND(F.lit(mask))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        distinct = df.groupBy("hi", "lo").agg(F.count("*").alias(f"{side}_texts"))
        keys = F.array(
            *[
                F.struct(
                    F.lit(sum(1 << i for i in chosen)).alias("_c"),
                    F.concat_ws(
                        "-", *[band(F.col("hi"), F.col("lo"), i).cast("string") for i in chosen]
                    ).alias("_k"),
                )
                for chosen in choices
            ]
        )
        return distinct.select(
            F.col("hi").alias(f"{side}_hi"), F.col("lo").alias(f"{side}_lo"),
            f"{side}_texts", F.inline(keys),
        )

    met = keyed(left, "left").join(keyed(right, "right"), ["_c", "_k"])
    dh = F.col("left_hi").bitwiseXOR(F.col("right_hi"))
    dl = F.col("left_lo").bitwiseXOR(F.col("right_lo"))
    # Choices are sets of bands, so the first one holds the lowest untouched bands: none
    # below its highest band is left out.
    untouched = F.lit(0)
    for i in range(bands):
        same = band(F.col("_dh"), F.col("_dl"), i) == 0
        untouched = untouched + F.when(same, F.lit(1 << i)).otherwise(F.lit(0))
    below = F.create_map(*[F.lit(v) for pair in up_to.items() for v in pair])[F.col("_c")]
    first = F.col("_m").bitwiseAND(below) == F.col("_c")
    distance = F.bit_count(F.col("_dh")) + F.bit_count(F.col("_dl"))
    return (
        met.withColumns({"_dh": dh, "_dl": dl})
        .withColumn("_d", distance)
        .filter(F.col("_d") <= allowed)
        .withColumn("_m", untouched)
        .filter(first)
        .select(
            "left_hi", "left_lo", "right_hi", "right_lo", "left_texts", "right_texts",
            (1.0 - F.col("_d") / F.lit(float(BITS))).alias("similarity"),
        )
    )


def text_sections(text: Column, markers: Mapping[str, str]) -> Column:
    """Named sections of a text as an array of (section, body); `markers` are
    patterns whose first group is the body."""
    lowered = F.lower(text)
    return F.array(
        *[
            F.struct(F.lit(n).alias("section"), F.regexp_extract(lowered, p, 1).alias("body"))
            for n, p in markers.items()
        ]
    )


def forbidden_terms(df: DataFrame, key: str, text: str, markers: Mapping[str, str],
                    terms: Sequence[str]) -> DataFrame:
    sections = df.select(key, F.inline(text_sections(F.col(text), markers)))
    listed = F.array(*[F.lit(t.lower()) for t in terms])
    hits = F.filter(listed, lambda t: F.col("body").contains(t))
    return sections.select(key, "section", F.explode(hits).alias("term"))


def jensen_shannon_drift(
    df: DataFrame, groups: Sequence[str], period: str, action: str, values: Sequence[str]
) -> DataFrame:
    """Action distribution and mean shifts between the first and the last period."""
    groups = list(groups)
    spans = df.groupBy(*groups).agg(
        F.min(period).alias("first_period"), F.max(period).alias("last_period")
    ).filter(F.col("first_period") != F.col("last_period"))
    edge = df.join(spans, groups).withColumns(
        {"_f": F.col(period) == F.col("first_period"), "_l": F.col(period) == F.col("last_period")}
    ).filter("_f OR _l")
    per_action = edge.groupBy(*groups, action).agg(
        F.count_if("_f").alias("_nf"), F.count_if("_l").alias("_nl")
    )
    totals = per_action.groupBy(*groups).agg(
        F.sum("_nf").alias("first_proposals"), F.sum("_nl").alias("last_proposals")
    )
    p = F.col("_nf") / F.col("first_proposals")
    q = F.col("_nl") / F.col("last_proposals")
    mid = 0.5 * (F.col("_p") + F.col("_q"))

    def part(c: Column) -> Column:
        return F.sum(F.when(c > 0, c * F.log2(c / mid)).otherwise(F.lit(0.0)))

    divergence = (
        per_action.join(totals, groups).withColumns({"_p": p, "_q": q}).groupBy(*groups).agg(
            (0.5 * part(F.col("_p")) + 0.5 * part(F.col("_q"))).alias(
                "action_distribution_jensen_shannon_bits"
            )
        )
    )
    shifts = edge.groupBy(*groups).agg(
        *[
            (F.avg(F.when(F.col("_l"), F.col(v))) - F.avg(F.when(F.col("_f"), F.col(v)))).alias(
                f"{v}_difference_last_minus_first"
            )
            for v in values
        ]
    )
    return spans.join(totals, groups).join(shifts, groups).join(divergence, groups)


# Fields and values that are never published.
FORBIDDEN_FIELDS = (
    "api_key", "authorization_decision", "ciphertext", "credential", "credentials", "decision",
    "decision_reason", "decision_row", "decision_rows", "decision_timestamp", "decisions",
    "decrypted_payload", "evidence", "evidence_content", "evidence_excerpt", "evidence_snippet",
    "evidence_text", "full_utility", "ground_truth", "harm_label", "hidden_key_path", "outcome",
    "outcome_timestamp", "outcomes", "plaintext", "predicted_decision", "private_key",
    "private_key_path", "provider_response", "provider_responses", "rationale", "rationale_text",
    "rationales", "raw_log", "raw_logs", "raw_path", "raw_paths", "raw_payload", "raw_response",
    "raw_responses", "realized_outcome", "realized_pnl", "realized_return", "reduced_utility",
)
@dataclass(frozen=True)
class NamePolicy:
    """A field name is forbidden if it begins and ends as told and holds, for each entry
    of `parts`, at least one of its strings."""

    starts: tuple[str, ...] = ("",)
    ends: tuple[str, ...] = ("",)
    parts: tuple[tuple[str, ...], ...] = ()

    def covers(self, name: str) -> bool:
        held = (any(p in name for p in options) for options in self.parts)
        return name.startswith(self.starts) and name.endswith(self.ends) and all(held)


# Names that must not be published, beside the list above.
NAME_POLICIES = (
    NamePolicy(parts=(("ciphertext", "plaintext", "rationale"),)),
    NamePolicy(starts=("freeze_snapshot", "risk_flag")),
    NamePolicy(ends=("snapshot_path",)),
    NamePolicy(starts=("evidence_",), parts=(("content", "excerpt", "path", "quote", "raw", "snippet", "text"),)),
    NamePolicy(
        parts=(
            ("raw",),
            ("directory", "file", "location", "log", "path", "payload", "request", "response", "uri"),
        )
    ),
    NamePolicy(parts=(("provider",), ("log", "payload", "request", "response"))),
    NamePolicy(parts=(("key_path",), ("api", "hidden", "private", "secret"))),
)

# A string is withheld for the first reason all of whose patterns it matches,
# in lower case, trimmed and with forward slashes.
IN_PATH, ABSOLUTE = "/", "^(?:/|[a-z]:/)"
VALUE_POLICIES = (
    ("hidden or sealed split value", ("^(?:community-hidden|community_hidden|hidden|sealed)$",)),
    ("hidden community split path", (IN_PATH, "community[_-]hidden")),
    ("raw, sealed, log, or snapshot path", (IN_PATH, "(?:^|/)(?:logs|raw|sealed|snapshots)/+[^/]")),
    ("hidden plaintext, ciphertext, or key path", (IN_PATH, "ciphertext|hidden_key|plaintext|private_key")),
    (
        "absolute hidden or private key path",
        (ABSOLUTE, "[.](?:jks|key|keystore|p12|pem|pfx)$|(?s)^(?=.*hidden).*(?:^|/)key(?:[._/-]|$)"),
    ),
)


def normal_field(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().casefold()).strip("_")


def forbidden_field(name: str, extra: Sequence[str] = ()) -> bool:
    """Is this field name raw, sealed, outcome, reasoning or secret material?"""
    plain = normal_field(name)
    listed = plain in FORBIDDEN_FIELDS or plain in extra
    return listed or any(policy.covers(plain) for policy in NAME_POLICIES)


#: White space around a value does not hide it.
WHITE = "\t\n\x0b\x0c\r "


def sensitive_value(value: Column) -> Column:
    """Reason a string must not be published, or NULL."""
    plain = F.translate(F.lower(F.trim(value, F.lit(WHITE))), "\\", "/")
    checked = [
        F.when(reduce(Column.__and__, [plain.rlike(p) for p in patterns]), F.lit(reason))
        for reason, patterns in VALUE_POLICIES
    ]
    return F.coalesce(*checked)


def _public(column: Column, kind: T.DataType, extra: Sequence[str]) -> Column | None:
    """The column as it may be published; None if nothing of it may."""
    if isinstance(kind, T.StructType):
        kept = []
        for f in kind.fields:
            inner = None if forbidden_field(f.name, extra) else _public(column[f.name], f.dataType, extra)
            if inner is not None:
                kept.append(inner.alias(f.name))
        return F.when(column.isNotNull(), F.struct(*kept)) if kept else None
    if isinstance(kind, T.ArrayType):
        if _public(column[0], kind.elementType, extra) is None:
            return None
        cleaned = F.transform(column, lambda item: _public(item, kind.elementType, extra))
        if isinstance(kind.elementType, T.StringType):
            return F.filter(cleaned, lambda item: item.isNotNull())
        return cleaned
    if isinstance(kind, T.MapType):
        if _public(F.map_values(column)[0], kind.valueType, extra) is None:
            return None
        if isinstance(kind.keyType, T.StringType):
            allowed = lambda key: ~_forbidden_key(key, extra) & sensitive_value(key).isNull()
            column = F.map_filter(column, lambda key, _: allowed(key))
        return F.transform_values(column, lambda _, item: _public(item, kind.valueType, extra))
    if isinstance(kind, T.StringType):
        return F.when(sensitive_value(column).isNull(), column)
    return column


def _forbidden_key(key: Column, extra: Sequence[str]) -> Column:
    """`forbidden_field` for a key that is data: the same policies as a column."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(key)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    found = plain.isin(*FORBIDDEN_FIELDS, *extra)
    for policy in NAME_POLICIES:
        covered = plain.rlike("^(?:" + "|".join(policy.starts) + ")") & plain.rlike("(?:" + "|".join(policy.ends) + ")$")
        for options in policy.parts:
            covered = covered & plain.rlike("|".join(options))
        found = found | covered
    return found


def public_projection(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Drop forbidden fields and map keys at every level and blank sensitive strings.  A
    struct without a publishable field goes too."""
    kept = []
    for f in df.schema.fields:
        column = None if forbidden_field(f.name, extra) else _public(df[f"`{f.name}`"], f.dataType, extra)
        if column is not None:
            kept.append(column.alias(f.name))
    return df.select(*kept)


def _cells(column: Column, kind: T.DataType, place: Column) -> list[Column]:
    """Arrays of (field, reason), one for each way down to the strings of a column."""
    if isinstance(kind, T.StringType):
        return [F.array(F.struct(place.alias("field"), sensitive_value(column).alias("reason")))]
    if isinstance(kind, T.StructType):
        return [
            cells for f in kind.fields
            for cells in _cells(column[f.name], f.dataType, F.concat(place, F.lit("." + f.name)))
        ]
    if isinstance(kind, T.MapType):
        entries = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        return _cells(F.map_entries(column), T.ArrayType(entries), place)
    if isinstance(kind, T.ArrayType):
        inside = len(_cells(F.lit(None), kind.elementType, place)) if not isinstance(kind.elementType, T.StructType) else 1
        if not inside:
            return []
        each = F.transform(
            column,
            lambda item, i: F.concat(
                F.array().cast("array<struct<field:string,reason:string>>"),
                *_cells(item, kind.elementType, F.concat(place, F.lit("["), i.cast("string"), F.lit("]"))),
            ),
        )
        return [F.coalesce(F.flatten(each), F.array().cast("array<struct<field:string,reason:string>>"))]
    return []


def sensitive_findings(df: DataFrame, key: str) -> DataFrame:
    """Every string that the projection would blank, with its place: nested strings and
    the keys of maps too."""
    cells = [c for f in df.schema.fields if f.name != key for c in _cells(df[f"`{f.name}`"], f.dataType, F.lit(f.name))]
    if not cells:
        return df.select(key, F.lit("").alias("field"), F.lit("").alias("reason")).limit(0)
    return df.select(key, F.inline(F.concat(*cells))).filter(F.col("reason").isNotNull())


def duplicate_headers(columns: Sequence[str]) -> list[str]:
    names = [normal_field(c) for c in columns]
    return sorted({n for n in names if names.count(n) > 1})
