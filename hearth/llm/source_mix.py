"""Mixing sources to target weights by weighted fair queueing, in SQL alone.

Every document stands in its source's queue, twice at most (two passes), in a shuffled order that depends on its id only.  Its
virtual finish time is the source's running token count up to its end, divided by the source's target.  All queues are merged by
virtual finish time and the merged line is cut where the budget is spent: each source has then given about its target.

No source is ever sorted in one task: running counts are taken inside slices of the shuffled order (the first three hex digits of
the id's digest) and start from the sums of the slices before.  The cut is found the same way: sums of slices of virtual time, then
a sort of the one slice in which the budget ends.  Rows that are equal in all of this stand or fall together.

The same statements run in Spark and in the comparison; only the word count and the digest of the id are spelled by each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.text import parked, word_count

#: Slices of virtual time; at v the slice is floor(SLICES * v / (1 + v)), so there is no last open-ended one.
SLICES = 4096
WEIGHTS = (3, 1, 2)

_SHARES = """
source_sizes AS (SELECT source, cast(sum(size) AS bigint) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM source_sizes),
weighed AS (SELECT source, source_size, place, CASE {cases} END AS weight, {cap} * source_size AS most FROM ranked),
lined AS (SELECT *,
    coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS most_before,
    sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from,
    sum(cast(source_size AS double)) OVER () * {share} AS budget FROM weighed),
filled AS (SELECT *, (budget - most_before) / weight_from >= most / weight AS is_full FROM lined),
spare AS (SELECT *, sum(CASE WHEN is_full THEN most ELSE 0.0 END) OVER () AS full_sum,
    sum(CASE WHEN is_full THEN 0.0 ELSE weight END) OVER () AS open_weight FROM filled),
shares AS (SELECT source, source_size, budget, place,
    CASE WHEN is_full THEN most ELSE (budget - full_sum) * weight / nullif(open_weight, 0.0) END AS target FROM spare)"""

_QUEUE = """
slice_sums AS (SELECT source, slice, cast(sum(size) AS bigint) AS total FROM sized GROUP BY source, slice),
slice_starts AS (SELECT source, slice, cast(coalesce(sum(total) OVER (PARTITION BY source ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS before FROM slice_sums),
inside AS (SELECT *, sum(size) OVER (PARTITION BY source, slice ORDER BY digest) AS upto FROM sized),
queued AS (SELECT i.doc_id, i.size, i.digest, h.source_size, h.target, h.budget, h.place, cast(i.upto + s.before AS double) AS finish
    FROM inside i JOIN slice_starts s ON i.slice = s.slice AND i.source IS NOT DISTINCT FROM s.source
    JOIN shares h ON i.source IS NOT DISTINCT FROM h.source)"""

_CUT = """
timed AS (SELECT size, digest, place, pass, budget, (finish + pass * source_size) / nullif(target, 0.0) AS v
    FROM queued CROSS JOIN (VALUES (0), (1)) AS p (pass) WHERE size > 0),
times AS (SELECT *, cast(floor({slices} * (v / (1 + v))) AS int) AS time_slice FROM timed),
time_sums AS (SELECT time_slice, cast(sum(size) AS bigint) AS total, max(budget) AS budget FROM times GROUP BY time_slice),
time_starts AS (SELECT *, coalesce(sum(total) OVER (ORDER BY time_slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM time_sums),
last_slice AS (SELECT time_slice AS cut_slice, before AS cut_before FROM time_starts WHERE before <= budget ORDER BY time_slice DESC LIMIT 1),
running AS (SELECT t.v, t.place, t.pass, t.digest, l.cut_before + sum(t.size) OVER (ORDER BY t.v, t.place, t.pass, t.digest) AS upto, t.budget
    FROM times t JOIN last_slice l ON t.time_slice = l.cut_slice),
final AS (SELECT v AS cut_v, place AS cut_place, pass AS cut_pass, digest AS cut_digest FROM running WHERE upto <= budget
    ORDER BY v DESC, place DESC, pass DESC, digest DESC LIMIT 1),
cut AS (SELECT l.cut_slice, f.cut_v, f.cut_place, f.cut_pass, f.cut_digest FROM last_slice l LEFT JOIN final f ON true)"""

_TAKES = """(CASE WHEN size > 0 AND cut_slice IS NOT NULL AND (cast(floor({slices} * ({v} / (1 + {v}))) AS int) < cut_slice
    OR (cast(floor({slices} * ({v} / (1 + {v}))) AS int) = cut_slice AND cut_v IS NOT NULL AND ({v} < cut_v OR ({v} = cut_v AND (place < cut_place
    OR (place = cut_place AND ({p} < cut_pass OR ({p} = cut_pass AND digest <= cut_digest)))))))) THEN 1 ELSE 0 END)"""


def _taken() -> str:
    parts = [_TAKES.format(v=f"((finish + {p} * source_size) / nullif(target, 0.0))", p=p, slices=SLICES) for p in (0, 1)]
    return f"cast(size * ({parts[0]} + {parts[1]}) AS bigint)"


def _shares(weights: tuple[int, ...], share: float, cap: float) -> str:
    cases = " ".join(f"WHEN (place - 1) % {len(weights)} = {k} THEN {float(w)!r}" for k, w in enumerate(weights))
    return _SHARES.format(cases=cases, share=f"cast({share!r} AS double)", cap=f"cast({cap!r} AS double)").replace("THEN ", "THEN 1e0 * ").replace("1e0 * most", "most")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0,
                doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, size (words), source_size, target (of its source), taken (words the mix takes).

    The budget is `share` times all words.  Sources in code-point order, null last, weigh `weights` in turn; no target exceeds `cap`
    times its source, the excess goes to the others by weight.  taken is 0, size or twice size.  Null and empty texts have size 0 and
    are taken 0 times; a null doc_id is one more id.  Rows with the same id and source share a place in the queue and are taken alike.
    An empty table gives an empty one; other columns are ignored.  `cap` is at most 2: a document has two passes.
    """
    spark = docs.sparkSession
    key = F.md5(F.coalesce(docs[doc_id].cast("string"), F.lit("null")).cast("binary"))
    sized = parked(docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), word_count(docs[text]).alias("size"),
                               key.alias("digest"), F.substring(key, 1, 3).alias("slice")), "sized")
    shares = parked(spark.sql(f"WITH {_shares(weights, share, cap).replace('sized', '{sized}')} SELECT * FROM shares", sized=sized), "shares")
    queued = parked(spark.sql(f"WITH {_QUEUE.replace('sized', '{sized}').replace('JOIN shares', 'JOIN {shares}')} SELECT * FROM queued", sized=sized, shares=shares), "queue")
    cut = spark.sql(f"WITH {_CUT.format(slices=SLICES).replace('FROM queued', 'FROM {queued}')} SELECT * FROM cut", queued=queued)
    return spark.sql(f"SELECT doc_id, size, source_size, target, {_taken()} AS taken FROM {{queued}} LEFT JOIN {{cut}} ON true", queued=queued, cut=cut)


def comparison_sql(docs: str = "documents") -> str:
    """The same result in DuckDB."""
    return f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    md5(coalesce(cast(doc_id AS varchar), 'null')) AS digest, substr(md5(coalesce(cast(doc_id AS varchar), 'null')), 1, 3) AS slice FROM {docs}),
{_shares(WEIGHTS, 1.5, 2.0)},
{_QUEUE},
{_CUT.format(slices=SLICES)}
SELECT doc_id, size, source_size, target, {_taken()} AS taken FROM queued LEFT JOIN cut ON true"""
