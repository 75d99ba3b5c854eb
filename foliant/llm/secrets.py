"""Secret scans that link the parts of multipart credentials.

Strong patterns report by themselves: keyword assignments, access identifiers with a known prefix
and long hexadecimal runs. Weak candidates (key identifiers, key secrets and endpoints) report only
when complementary parts lie in the same scope, ``SCOPE`` code points of one text: a weak identifier
needs a secret, a weak secret needs an identifier, and an endpoint needs both.

The interval join runs inside the row. Candidates of a text are sorted by start, and what a candidate
needs of a part is the greatest stop before it and the least start after it. Both are looked up in
chunks of ``CHUNK`` candidates, so the work stays near linear for texts with any number of candidates
of any length. No shuffle at all. Texts without any cheap marker skip the extraction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import fresh, pinned

SCOPE = 200
#: Candidates that are gone through one by one; beyond that by chunks of so many.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern whose leftmost non-overlapping matches count if they are long enough and hold each of the needed patterns."""

    name: str
    part: str
    pattern: str
    least: int
    group: int = 0
    needs: tuple[str, ...] = ()
    most: int = 1_000_000_000


#: The patterns.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = (
    Kind("assign", "secret", KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Kind("access", "id", "AKIA[A-Z0-9]+", 16),
    Kind("hex", "secret", "[0-9a-f]+", 32),
)
WEAK = (
    Kind("key_id", "id", "[A-Z0-9]{16,}", 16, needs=("[0-9]", "[A-Z]"), most=32),
    Kind("key_secret", "secret", "[A-Za-z0-9+/=_-]{32,}", 32, needs=("[0-9]", "[a-z]", "[A-Z]"), most=88),
    Kind("endpoint", "endpoint", r"(https?|wss?|s3|amqp|redis|mongodb|postgres(ql)?|mysql)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", 10),
)
KINDS = BASE + WEAK


EMPTY = "array<struct<start:int,kind_no:int,stop:int,kind:string,part:string>>"


def _spelling(kind: Kind) -> str:
    # [0-9a-f]{32,} finds the same long runs as [0-9a-f]+ does, without a match for each short run.
    return kind.pattern[:-1] + f"{{{kind.least},}}" if kind.name == "hex" else kind.pattern


def found(text: Column, kind: Kind) -> Column:
    """array<struct<m, v, g>>: each match, the group that counts, and the length of what lies before it; one more at the end has no match."""
    pattern = _spelling(kind)
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), kind.group) if kind.group else whole
    return F.arrays_zip(whole.alias("m"), value.alias("v"), F.transform(gaps, F.length).alias("g"))


def chunks(array: Column) -> Column:
    """The numbers of the chunks of an array; one for an empty array."""
    return F.sequence(F.lit(0), F.greatest(F.floor((F.size(array) - 1) / CHUNK), F.lit(0)).cast("int"))


def chunk(array: Column, c: Column) -> Column:
    return F.slice(array, c * CHUNK + 1, F.lit(CHUNK))


def chunk_lengths(sized: Column) -> Column:
    """Code points of each chunk of found(), which must be a column."""
    own = lambda x: x["g"] + F.coalesce(F.length(x["m"]), F.lit(0))
    return F.transform(chunks(sized), lambda c: F.aggregate(chunk(sized, c), F.lit(0), lambda a, x: a + own(x)))


def matches(sized: Column, lengths: Column, kind: Kind) -> Column:
    """array<struct<start, kind_no, stop, kind, part>> of the matches that count, in code points; sized and lengths must be columns."""
    no = KINDS.index(kind)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        holds = x["m"].isNotNull() & (F.length(x["v"]) >= kind.least) & (F.length(x["v"]) <= kind.most)
        for need in kind.needs:
            holds &= x["v"].rlike(need)
        span = F.array(F.struct(begin.alias("start"), F.lit(no).alias("kind_no"), end.alias("stop"), F.lit(kind.name).alias("kind"), F.lit(kind.part).alias("part")))
        return F.struct(end.alias("at"), F.when(holds, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def of_chunk(c: Column) -> Column:
        base = F.aggregate(F.slice(lengths, F.lit(1), c), F.lit(0), lambda a, x: a + x)
        return F.aggregate(chunk(sized, c), F.struct(base.alias("at"), F.array().cast(EMPTY).alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(chunks(sized), of_chunk))


def scan(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """docs with ``secrets`` added (or _secrets if docs has it): array<struct<kind, start, stop, value>> by start, then kind.

    A null or empty text has none. Weak candidates that overlap a strong match are that match. Equal
    rows get equal spans, keys do not matter, and an empty table stays empty.
    """
    parts = ("id", "secret")
    working = ("scanned", "strong", "weak", "all", *(f"{x}_{k.name}" for k in KINDS for x in ("found", "lengths")), *(f"{x}_{p}" for p in parts for x in ("stops", "starts", "before", "after")))
    names = {n: fresh(docs, n) for n in ("secrets", *working)}
    col = {n: F.col(names[n]) for n in working}
    out = docs.withColumn(names["scanned"], F.coalesce(F.col(text), F.lit("")))

    def gathered(df: DataFrame, name: str, kinds: tuple[Kind, ...], marker: str) -> DataFrame:
        t = col["scanned"]
        none = F.array().cast("array<struct<m:string,v:string,g:int>>")
        has = {k.name: t.rlike(marker) & t.rlike(k.pattern if k.name != "hex" else "[0-9a-f]{32}") for k in kinds}
        df = df.withColumns({names[f"found_{k.name}"]: F.when(has[k.name], found(t, k)).otherwise(none) for k in kinds})
        df = df.withColumns({names[f"lengths_{k.name}"]: chunk_lengths(col[f"found_{k.name}"]) for k in kinds})
        each = [F.when(F.size(col[f"found_{k.name}"]) > 0, matches(col[f"found_{k.name}"], col[f"lengths_{k.name}"], k)).otherwise(F.array().cast(EMPTY)) for k in kinds]
        return df.withColumn(names[name], F.sort_array(F.concat(*each)))

    out = gathered(out, "strong", BASE, f"{KEYWORD}|AKIA|[0-9a-f]{{32}}")
    out = gathered(out, "weak", WEAK, "[A-Z0-9]{16}|[A-Za-z0-9+/=_-]{32}|://")
    strong, weak, every = col["strong"], col["weak"], col["all"]
    # Both arrays are read twice below, so that neither is computed again for each element.
    apart = F.filter(weak, lambda w: ~F.exists(strong, lambda s: (s["start"] < w["stop"]) & (w["start"] < s["stop"])))
    out = out.withColumn(names["all"], F.when(F.size(weak) == 0, strong).otherwise(F.sort_array(F.concat(strong, apart))))
    never = 2**31 - 1

    def edge(p: str, side: str, otherwise: int) -> Column:
        return F.transform(every, lambda y: F.when(y["part"] == p, y[side]).otherwise(otherwise))

    def by_chunk(array: Column, most) -> Column:
        return F.transform(chunks(every), lambda c: most(chunk(array, c)))

    out = out.withColumns({names[f"stops_{p}"]: edge(p, "stop", -1_000_000) for p in parts} | {names[f"starts_{p}"]: edge(p, "start", never) for p in parts})
    out = out.withColumns({names[f"before_{p}"]: by_chunk(col[f"stops_{p}"], F.array_max) for p in parts} | {names[f"after_{p}"]: by_chunk(col[f"starts_{p}"], F.array_min) for p in parts})

    def has(p: str, x: Column, i: Column) -> Column:
        """Of those that start before x the greatest stop decides, of those after it the least start."""
        c = F.floor(i / CHUNK).cast("int")
        least = F.least(F.size(every), (c + 1) * CHUNK)
        stop = F.greatest(F.array_max(F.slice(col[f"before_{p}"], F.lit(1), c)), F.array_max(F.slice(col[f"stops_{p}"], c * CHUNK + 1, i - c * CHUNK)))
        start = F.least(F.array_min(F.slice(col[f"starts_{p}"], i + 2, F.greatest(least - i - 1, F.lit(0)))), F.array_min(F.slice(col[f"after_{p}"], c + 2, F.size(col[f"after_{p}"]))))
        return (F.coalesce(stop, F.lit(-1_000_000)) > x["start"] - scope) | (F.coalesce(start, F.lit(never)) < x["stop"] + scope)

    def linked(x: Column, i: Column) -> Column:
        return (x["kind_no"] < len(BASE)) | F.when(x["part"] == "id", has("secret", x, i)).when(x["part"] == "secret", has("id", x, i)).otherwise(has("id", x, i) & has("secret", x, i))

    kept = F.when(F.size(every) == 0, every).otherwise(F.filter(every, linked))
    value = lambda x: F.substr(col["scanned"], x["start"] + 1, x["stop"] - x["start"])
    spans = F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), value(x).alias("value")))
    return out.withColumn(names["secrets"], pinned(spans)).drop(*(names[n] for n in working))


def spelled(spans: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    names = [k.name for k in kinds]
    chosen = F.filter(spans, lambda s: s["kind"].isin(names))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, name: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == name)).cast("long")
