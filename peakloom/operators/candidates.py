"""Candidate sequence sets for homology queries.

``candidates``: set_id, seq, score; one row per sequence of a set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.session import cut_lineage
from peakloom.functions.ordered import row_numbers, running_sums
from peakloom.operators.components import connected_components

BEST_FIRST = lambda: [F.col("score").desc(), F.col("seq")]


def shared_sequence_links(candidates: DataFrame) -> DataFrame:
    """A star per sequence: each set is linked to the smallest set holding the sequence."""
    held = candidates.select("set_id", "seq").distinct()
    hub = held.groupBy("seq").agg(F.min("set_id").alias("hub"))
    return held.join(hub, "seq").filter("set_id <> hub").select("set_id", "hub").distinct()


def suffix_links(candidates: DataFrame, existing: DataFrame, min_len: int = 11, min_suffix: int = 9) -> DataFrame:
    """Boundary candidates (leading B) linked to the smallest existing set holding one of their long suffixes."""
    starts = F.sequence(F.lit(2), F.length("seq") - (min_suffix - 1))
    suffixes = (
        candidates.filter(F.col("seq").startswith("B") & (F.length("seq") >= min_len))
        .select("set_id", "seq", F.explode(starts).alias("at"))
        .select("set_id", "seq", F.expr("substring(seq, at)").alias("suffix"))
        .distinct()
    )
    known = existing.groupBy(F.col("seq").alias("suffix")).agg(F.min("set_id").alias("linked_set"))
    return suffixes.join(known, "suffix").groupBy("set_id", "seq").agg(F.min("linked_set").alias("linked_set"))


def merge_candidates(candidates: DataFrame, k: int, extra_links: DataFrame | None = None) -> DataFrame:
    """Union of linked sets with the k best distinct sequences of each."""
    links = shared_sequence_links(candidates)
    if extra_links is not None:
        links = links.unionByName(extra_links)
    comp = connected_components(links, "set_id", "hub").withColumnRenamed("node", "set_id")
    merged = (
        candidates.join(comp, "set_id", "left")
        .groupBy(F.coalesce("component", "set_id").alias("merged_id"), "seq")
        .agg(F.max("score").alias("score"))
    )
    rn = F.row_number().over(W.partitionBy("merged_id").orderBy(*BEST_FIRST()))
    return merged.withColumn("rank", rn.cast("bigint")).filter(F.col("rank") <= k)


def scored_lines(lines: DataFrame, min_score: float, step: float = 0.2) -> DataFrame:
    """Lines of dash-separated sequences: the n-th one loses n steps; weak lines are dropped."""
    return (
        lines.filter(F.col("line_score") >= min_score)
        .select(*[c for c in lines.columns if c != "line"], F.posexplode(F.split("line", "-")).alias("n", "seq"))
        .filter(F.col("seq") != "")
        .withColumn("score", F.col("line_score") - F.col("n") * step)
    )


def set_letters(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("set_id").agg(F.sum(F.length("seq")).alias("letters"), F.max("score").alias("best"))


def _in_score_order(sets: DataFrame, chunk: int) -> DataFrame:
    """Running letters over sets by best score; buckets of (score, id range) keep it distributed."""
    bucket = F.struct((-F.col("best")).alias("s"), F.floor(F.col("set_id") / chunk).alias("c"))
    return running_sums(sets, [], bucket, [F.col("best").desc(), F.col("set_id")], {"cum": F.col("letters")})


def write_query(candidates: DataFrame, max_size: int, min_score: int, reserve: int = 256, chunk: int = 65_536) -> DataFrame:
    """Sets by best score until the letter budget is nearly used."""
    sets = _in_score_order(set_letters(candidates).filter(F.col("best") >= min_score), chunk)
    return sets.filter(F.col("cum") - F.col("letters") + reserve < max_size)


def split_query(candidates: DataFrame, max_size: int, chunk: int = 65_536) -> DataFrame:
    sets = _in_score_order(set_letters(candidates), chunk)
    return sets.withColumn("part", F.expr(f"(cum - 1) div {max_size}"))


def mark_keep_exclude(candidates: DataFrame, keep: DataFrame, exclude: DataFrame, min_suffix: int = 9) -> DataFrame:
    """Set-level marks; keep wins over exclude, excluded sets are dropped."""
    seqs = candidates.select("set_id", "seq").distinct()
    kept = seqs.join(keep.select("seq").distinct(), "seq", "left_semi").select("set_id").distinct()
    # position 1 is the sequence itself, of any length
    starts = F.when(F.length("seq") >= min_suffix, F.sequence(F.lit(1), F.length("seq") - (min_suffix - 1))).otherwise(F.array(F.lit(1)))
    tails = seqs.select("set_id", F.col("seq").alias("whole"), F.explode(starts).alias("at")).select(
        "set_id", F.expr("substring(whole, at)").alias("seq")
    )
    banned = tails.join(exclude.select("seq").distinct(), "seq", "left_semi").select("set_id").distinct()
    return (
        candidates.join(kept.withColumn("keep", F.lit(True)), "set_id", "left")
        .join(banned.withColumn("ban", F.lit(True)), "set_id", "left")
        .filter(F.col("keep").isNotNull() | F.col("ban").isNull())
        .withColumn("keep", F.coalesce("keep", F.lit(False)))
        .drop("ban")
    )


def query_with_history(
    candidates: DataFrame, history: DataFrame, mapped: DataFrame, caps: Sequence[tuple[int, int]], base_cap: int = 3,
    max_size: int = 1_000_000, min_score: int = 0, reserve: int = 256, chunk: int = 65_536,
) -> DataFrame:
    """Choose the sequences of each set for the next query.

    Kept sets go whole. Otherwise mapped sequences always go, unused ones fill up to a cap
    that depends on the best score, and a set left empty takes its best sequence used once.
    Sets go by best score, down to ``min_score``, until the letters of what was chosen come within
    ``reserve`` of ``max_size``. The history counts are those before this query (``update_history``
    adds the new ones). ``candidates`` carries ``keep``; ``history`` is seq, uses; ``caps`` is (score above, cap).
    """
    marked = (
        candidates.join(history.select("seq", "uses"), "seq", "left")
        .join(mapped.select("seq").distinct().withColumn("mapped", F.lit(True)), "seq", "left")
        .withColumn("uses", F.coalesce("uses", F.lit(0)))
        .withColumn("mapped", F.coalesce("mapped", F.lit(False)))
    )
    cap = F.lit(base_cap)
    for above, n in caps:
        cap = F.when(F.col("best") > above, F.lit(n)).otherwise(cap)
    unused = ~F.col("mapped") & (F.col("uses") == 0)
    once = F.min(F.when(~F.col("mapped") & (F.col("uses") == 1), F.struct((-F.col("score")).alias("neg"), "seq")))
    sets = marked.groupBy("set_id").agg(
        F.max("score").alias("best"),
        F.count_if("mapped").alias("n_mapped"),
        F.count_if(unused).alias("n_unused"),
        once.alias("once"),
    ).withColumn("cap", cap)
    whole = marked.filter("keep").select("set_id", "seq", "score", F.lit("keep").alias("reason"))
    open_rows = marked.filter(~F.col("keep"))
    always = open_rows.filter("mapped").select("set_id", "seq", "score", F.lit("mapped").alias("reason"))
    most = max([base_cap, *[n for _, n in caps]])
    rn = F.row_number().over(W.partitionBy("set_id").orderBy(*BEST_FIRST()))
    fresh = (
        open_rows.filter(unused)
        .withColumn("rn", rn)
        .filter(F.col("rn") <= most)
        .join(sets.select("set_id", "n_mapped", "cap"), "set_id")
        .filter(F.col("n_mapped") + F.col("rn") <= F.col("cap"))
        .select("set_id", "seq", "score", F.lit("unused").alias("reason"))
    )
    open_sets = open_rows.select("set_id").distinct()
    again = (
        sets.filter((F.col("n_mapped") == 0) & (F.col("n_unused") == 0) & F.col("once").isNotNull())
        .join(open_sets, "set_id", "left_semi")
        .select("set_id", F.col("once.seq").alias("seq"), (-F.col("once.neg")).alias("score"), F.lit("used_once").alias("reason"))
    )
    # read twice below, and small against the candidates
    chosen = cut_lineage(whole.unionByName(always).unionByName(fresh).unionByName(again))
    letters = chosen.groupBy("set_id").agg(F.sum(F.length("seq")).alias("letters"))
    sized = letters.join(sets.filter(F.col("best") >= min_score).select("set_id", "best"), "set_id")
    fits = _in_score_order(sized, chunk).filter(F.col("cum") - F.col("letters") + reserve < max_size)
    return chosen.join(fits.select("set_id"), "set_id", "left_semi")


def update_history(history: DataFrame, chosen: DataFrame) -> DataFrame:
    used = chosen.groupBy("seq").agg(F.count(F.lit(1)).alias("uses"))
    return history.select("seq", "uses").unionByName(used).groupBy("seq").agg(F.sum("uses").alias("uses"))


def keyword_hit(name: Column, keywords: Sequence[str]) -> Column:
    """Case-folded substring test against a parameter list of keywords."""
    folded = F.lower(name)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | folded.contains(word.lower())
    return hit


def keyword_match(names: DataFrame, keywords: DataFrame, id_col: str, name_col: str, gram: int = 3) -> DataFrame:
    """Names holding any keyword of a keyword table, without a nested-loop join.

    Names and keywords meet on the first ``gram`` letters of the keyword; shorter keywords
    use their own length. The substring test is then exact. Keywords: ``keyword``.
    """
    folded = keywords.select(F.lower("keyword").alias("keyword")).filter(F.length("keyword") > 0).distinct()
    probes = folded.withColumn("gram", F.substring("keyword", 1, gram))
    text = F.lower(name_col)
    grams = F.array_distinct(
        F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in range(1, gram + 1)]))
    )
    laid = names.select(id_col, text.alias("_t"), F.explode(grams).alias("gram"))
    return laid.join(probes, "gram").filter(F.col("_t").contains(F.col("keyword"))).select(id_col, "keyword").distinct()


def extract_id(name: Column, pattern: str = r"gi\|([0-9]+)") -> Column:
    """The accession inside a name, else the whole name."""
    found = F.regexp_extract(name, pattern, 1)
    return F.when(found != "", found).otherwise(name)


def id_match(names: DataFrame, ids: DataFrame, name_col: str, pattern: str) -> DataFrame:
    return names.withColumn("acc", extract_id(F.col(name_col), pattern)).join(ids.select("acc").distinct(), "acc", "left_semi")


def classify_proteins(names: DataFrame, name_col: str, ids: DataFrame, pattern: str, keep: Sequence[str], exclude: Sequence[str]) -> DataFrame:
    """good (listed id or keep keyword), else excluded (exclude keyword), else neutral."""
    known = ids.select("acc").distinct().withColumn("_known", F.lit(True))
    joined = names.withColumn("acc", extract_id(F.col(name_col), pattern)).join(known, "acc", "left")
    good = F.col("_known").isNotNull() | keyword_hit(F.col(name_col), keep)
    cls = F.when(good, "good").when(keyword_hit(F.col(name_col), exclude), "excluded").otherwise("neutral")
    return joined.withColumn("class", cls).drop("_known")


def final_query(parts: DataFrame) -> DataFrame:
    return parts.select("seq").distinct().orderBy("seq")


def upsert_pairs(current: DataFrame, incoming: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add the pairs that are not yet known; running it twice changes nothing."""
    fresh = incoming.select(*on).distinct().join(current, list(on), "left_anti")
    return current.select(*on).unionByName(fresh)


def report_by_class(rows: DataFrame, cls: str, score: str, key: str, chunk: int = 65_536) -> DataFrame:
    """Row number by descending score in each class, split by (score, id range)."""
    bucket = F.struct((-F.col(score)).alias("s"), F.floor(F.col(key) / chunk).alias("c"))
    return row_numbers(rows, [cls], bucket, [F.col(score).desc(), F.col(key)], "position")
