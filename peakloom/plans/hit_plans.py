"""FDR, protein tables and homology-query candidate sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.operators import candidates as cand, fdr
from peakloom.operators.components import connected_components
from peakloom.plans.bindings import MIN_CANDIDATE, TARGET_FDR, levels_sql
from peakloom.plans.registry import query


def levels(t):
    return fdr.fdr_levels(t.hits())


def passed(t):
    return fdr.filter_at_fdr(t.hits(), levels(t), TARGET_FDR)


def scores(t):
    return fdr.protein_scores(passed(t))


@query("FDR1", "SELECT score, n_target, n_decoy, round(fdr, 6) AS fdr FROM hit_levels")
def fdr1(t):
    return levels(t).withColumn("fdr", F.round("fdr", 6))


@query("FDR2", """SELECT score, round(CASE WHEN score = m AND fdr IS NOT NULL THEN fdr ELSE coalesce(min(fdr) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING), 1.0) END, 6) AS fdr FROM (
    SELECT g.score, l.fdr, max(g.score) OVER () AS m FROM (SELECT unnest(range(0, (SELECT max(score) + 1 FROM hits))) AS score) g LEFT JOIN hit_levels l USING (score))""")
def fdr2(t):
    return fdr.score_to_fdr(levels(t)).withColumn("fdr", F.round("fdr", 6))


@query("FDR3", "SELECT protein_id, is_decoy, total, n_peptides, best_score FROM protein_scores")
def fdr3(t):
    return scores(t).drop("adj_score")


@query("FDR4", "SELECT protein_id, adj_score FROM protein_scores")
def fdr4(t):
    return scores(t).select("protein_id", "adj_score")


@query("FDR5", f"SELECT score, n_target, n_decoy, round(fdr, 6) AS fdr FROM ({levels_sql('protein_scores', 'adj_score')})")
def fdr5(t):
    return fdr.fdr_levels(scores(t), "adj_score").withColumn("fdr", F.round("fdr", 6))


# the matched subject of a hit, of the length of its peptide text
SUBJECT = "'SUB' || (protein_id*7 + score) % 11"
BEST_HIT = f"""SELECT peptide, score, protein_id, is_decoy, subject FROM (SELECT *, row_number() OVER (PARTITION BY peptide ORDER BY score DESC, protein_id, subject) AS rn FROM (SELECT *, {SUBJECT} AS subject FROM hits)) WHERE rn = 1"""


def subject_hits(t):
    subject = F.concat(F.lit("SUB"), ((F.col("protein_id") * 7 + F.col("score")) % 11).cast("string"))
    return t.hits().withColumn("subject", subject)


@query("FDR6", f"SELECT peptide, score, protein_id, is_decoy FROM ({BEST_HIT})")
def fdr6(t):
    return fdr.best_hit_per_peptide(t.hits())


@query("FDR7", f"""WITH b AS (SELECT h.*, l.fdr FROM ({BEST_HIT}) h JOIN hit_levels l USING (score)), s AS (SELECT max(score) AS stop FROM b WHERE fdr > 0.02)
    SELECT peptide, score, protein_id, is_decoy, subject, round(fdr, 6) AS fdr FROM b, s WHERE stop IS NULL OR score >= stop""")
def fdr7(t):
    out = fdr.peptide_report(fdr.best_hit_per_peptide(subject_hits(t), ["subject"]), levels(t), 0.01)
    return out.withColumn("fdr", F.round("fdr", 6))


# proteins one by one, best first: a founder unless an earlier founder holds half of its alignments
GROUPS = """al AS MATERIALIZED (SELECT protein_id, peptide, count(*) AS times FROM passed GROUP BY 1, 2), rk AS MATERIALIZED (SELECT protein_id, row_number() OVER (ORDER BY adj_score DESC, protein_id) AS i, n_peptides AS n FROM protein_scores),
    sh AS MATERIALIZED (SELECT p.i, p.n, q.i AS better, sum(x.times) AS shared FROM rk p JOIN al x USING (protein_id) JOIN al y ON y.peptide = x.peptide JOIN rk q ON q.protein_id = y.protein_id WHERE q.i < p.i GROUP BY 1, 2, 3),
    cv AS MATERIALIZED (SELECT i, coalesce(list(better) FILTER (WHERE shared*2 >= rk.n), []) AS covers FROM rk LEFT JOIN sh USING (i) GROUP BY 1),
    steps AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS founders UNION ALL SELECT cv.i, CASE WHEN list_has_any(covers, founders) THEN founders ELSE list_append(founders, cv.i) END FROM steps JOIN cv ON cv.i = steps.i + 1),
    fo AS MATERIALIZED (SELECT unnest(founders) AS i FROM (SELECT founders FROM steps ORDER BY i DESC LIMIT 1)),
    me AS (SELECT i, better FROM (SELECT sh.*, row_number() OVER (PARTITION BY sh.i ORDER BY shared DESC, better) AS rn FROM sh SEMI JOIN fo ON fo.i = sh.better ANTI JOIN fo f ON f.i = sh.i) WHERE rn = 1),
    groups AS MATERIALIZED (SELECT r.protein_id, coalesce(g.protein_id, r.protein_id) AS group_id, me.i IS NULL AS is_founder FROM rk r LEFT JOIN me USING (i) LEFT JOIN rk g ON g.i = me.better)"""


@query("FDR8", f"WITH RECURSIVE {GROUPS} SELECT protein_id, group_id, is_founder FROM groups")
def fdr8(t):
    return fdr.protein_groups(scores(t), passed(t))


@query("FDR9", f"""WITH RECURSIVE {GROUPS}, lv AS ({levels_sql('protein_scores', 'adj_score')}), sz AS (SELECT group_id, count(*) AS n_proteins FROM groups GROUP BY 1)
    SELECT g.group_id, n_proteins, n_peptides, adj_score, total, round(fdr, 6) AS fdr, 'P' || g.group_id || '|protein' AS top_name, 'P' || g.protein_id AS accession
    FROM groups g JOIN sz USING (group_id) JOIN protein_scores s ON s.protein_id = g.group_id JOIN lv ON lv.score = s.adj_score""")
def fdr9(t):
    s = scores(t)
    names = s.select("protein_id", F.concat(F.lit("P"), F.col("protein_id").cast("string"), F.lit("|protein")).alias("name"))
    out = fdr.group_report(fdr.protein_groups(s, passed(t)), s, names, fdr.fdr_levels(s, "adj_score"))
    return out.withColumn("fdr", F.round("fdr", 6))


@query("FDR10", "SELECT n_decoy, n_hits, round(n_decoy/n_hits, 6) AS ratio, n_decoy/n_hits < 0.25 AS warn FROM (SELECT count(*) FILTER (WHERE is_decoy) AS n_decoy, count(*) AS n_hits FROM hits)")
def fdr10(t):
    return fdr.decoy_ratio(t.hits(), 0.25).withColumn("ratio", F.round("ratio", 6))


@query("JN18", """WITH x AS (SELECT set_id, 'B' || seq AS seq FROM candidates WHERE length(seq) >= 10),
    s AS (SELECT set_id, seq, unnest(list_transform(range(2, length(seq) - 7), lambda i: substr(seq, i))) AS suffix FROM x),
    k AS (SELECT seq AS suffix, min(set_id) AS linked_set FROM document_words GROUP BY 1) SELECT set_id, seq, min(linked_set) AS linked_set FROM s JOIN k USING (suffix) GROUP BY 1, 2""")
def jn18(t):
    new = t.candidates().filter(F.length("seq") >= 10).select("set_id", F.concat(F.lit("B"), "seq").alias("seq"))
    return cand.suffix_links(new, t.words("documents", "doc_id", 9).select("set_id", "seq"))


@query("QRY1", """WITH RECURSIVE links AS (SELECT DISTINCT a.set_id AS a, b.set_id AS b FROM candidates a JOIN candidates b USING (seq)),
    reach AS (SELECT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node), comp AS (SELECT node, min(root) AS root FROM reach GROUP BY 1),
    m AS (SELECT root AS merged_id, seq, max(score) AS score FROM candidates JOIN comp ON node = set_id GROUP BY 1, 2)
    SELECT merged_id, seq, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY merged_id ORDER BY score DESC, seq) AS rank FROM m) WHERE rank <= 20""")
def qry1(t):
    return cand.merge_candidates(t.candidates(), 20).select("merged_id", "seq", "score", "rank")


@query("QRY2", """SELECT set_id, turn, CAST(n - 1 AS INTEGER) AS n, seq[n] AS seq, round(line_score - (n - 1)*0.2, 6) AS score FROM (SELECT *, unnest(range(1, len(seq) + 1)) AS n FROM (
    SELECT conv_id AS set_id, turn, CAST(length(text) AS DOUBLE) AS line_score, list_filter(string_split(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda w: w <> '') AS seq FROM conversations) WHERE line_score >= 300)""")
def qry2(t):
    from peakloom.functions.text import words

    lines = t.raw("conversations").select(
        F.col("conv_id").alias("set_id"), "turn", F.length("text").cast("double").alias("line_score"), F.array_join(words(F.col("text"), 1), "-").alias("line")
    )
    return cand.scored_lines(lines, 300.0).select("set_id", "turn", "n", "seq", F.round("score", 6).alias("score"))


ORDERED_SETS = """SELECT *, CAST(sum(letters) OVER (ORDER BY best DESC, set_id) AS BIGINT) AS cum FROM (SELECT set_id, CAST(sum(length(seq)) AS BIGINT) AS letters, max(score) AS best FROM candidates GROUP BY 1)"""


@query("QRY3", f"SELECT set_id, letters, best, cum FROM (SELECT * FROM ({ORDERED_SETS}) WHERE best >= 50) WHERE cum - letters + 256 < 30000")
def qry3(t):
    return cand.write_query(t.candidates(), 30_000, 50, chunk=16)


@query("QRY4", f"SELECT set_id, letters, best, cum, CAST((cum - 1)//10000 AS BIGINT) AS part FROM ({ORDERED_SETS})")
def qry4(t):
    return cand.split_query(t.candidates(), 10_000, chunk=16)


@query("QRY5", """WITH kept AS (SELECT DISTINCT set_id FROM candidates SEMI JOIN benchmark_words USING (seq)),
    tails AS (SELECT set_id, seq AS whole, unnest(CASE WHEN length(seq) >= 9 THEN list_transform(range(1, length(seq) - 7), lambda i: substr(seq, i)) ELSE [seq] END) AS seq FROM candidates),
    banned AS (SELECT DISTINCT set_id FROM tails SEMI JOIN (SELECT seq FROM document_words JOIN labels ON doc_id = set_id WHERE toxic = 1) x USING (seq))
    SELECT set_id, seq, score, set_id IN (SELECT set_id FROM kept) AS keep FROM candidates WHERE set_id IN (SELECT set_id FROM kept) OR set_id NOT IN (SELECT set_id FROM banned)""")
def qry5(t):
    toxic = t.raw("labels").filter("toxic = 1").select(F.col("doc_id").alias("set_id"))
    banned = t.words("documents", "doc_id", MIN_CANDIDATE).join(toxic, "set_id", "left_semi").select("seq")
    return cand.mark_keep_exclude(t.candidates(), t.words("benchmark", "item_id", MIN_CANDIDATE).select("seq"), banned).select("set_id", "seq", "score", "keep")


def history_parts(t):
    best = t.candidates().groupBy("set_id", "seq").agg(F.max("score").alias("score"))
    keep = t.candidates().join(t.words("benchmark", "item_id", MIN_CANDIDATE).select("seq").distinct(), "seq", "left_semi").select("set_id").distinct()
    cands = best.join(keep.withColumn("keep", F.lit(True)), "set_id", "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    words = t.words("documents", "doc_id", MIN_CANDIDATE)
    history = words.groupBy("seq").agg(F.count(F.lit(1)).alias("uses"))
    mapped = words.filter(F.length("seq") >= 12).select("seq")
    return cands, history, mapped


QRY6 = f"""WITH c AS (SELECT set_id, seq, max(score) AS score FROM candidates GROUP BY 1, 2), kept AS (SELECT DISTINCT set_id FROM candidates SEMI JOIN benchmark_words USING (seq)),
    h AS (SELECT seq, count(*) AS uses FROM document_words WHERE length(seq) >= {MIN_CANDIDATE} GROUP BY 1),
    m AS (SELECT c.*, coalesce(uses, 0) AS uses, coalesce(length(c.seq) >= 12 AND uses > 0, FALSE) AS mapped, k.set_id IS NOT NULL AS keep, max(score) OVER (PARTITION BY c.set_id) AS best
      FROM c LEFT JOIN h USING (seq) LEFT JOIN kept k USING (set_id)),
    r AS (SELECT *, count(*) FILTER (WHERE mapped) OVER w AS n_mapped, count(*) FILTER (WHERE NOT mapped AND uses = 0) OVER w AS n_unused,
      row_number() OVER (PARTITION BY set_id, mapped, uses ORDER BY score DESC, seq) AS rn, CASE WHEN best > 90 THEN 20 WHEN best > 80 THEN 5 WHEN best > 70 THEN 4 ELSE 3 END AS cap FROM m WINDOW w AS (PARTITION BY set_id)),
    q AS (SELECT set_id, seq, score, best, reason FROM (SELECT *, CASE WHEN keep THEN 'keep' WHEN mapped THEN 'mapped' WHEN uses = 0 AND n_mapped + rn <= cap THEN 'unused'
      WHEN n_mapped = 0 AND n_unused = 0 AND uses = 1 AND rn = 1 THEN 'used_once' END AS reason FROM r) WHERE reason IS NOT NULL AND best >= 50),
    o AS (SELECT set_id, letters, sum(letters) OVER (ORDER BY best DESC, set_id) AS cum FROM (SELECT set_id, best, sum(length(seq)) AS letters FROM q GROUP BY 1, 2))
    SELECT set_id, seq, score, reason FROM q SEMI JOIN (SELECT set_id FROM o WHERE cum - letters + 256 < 30000) USING (set_id)"""


@query("QRY6", QRY6)
def qry6(t):
    cands, history, mapped = history_parts(t)
    return cand.query_with_history(cands, history, mapped, [(70, 4), (80, 5), (90, 20)], max_size=30_000, min_score=50, chunk=16)


@query("QRY6H", f"""WITH q AS ({QRY6}), h AS (SELECT seq, count(*) AS uses FROM document_words WHERE length(seq) >= {MIN_CANDIDATE} GROUP BY 1 UNION ALL SELECT seq, count(*) AS uses FROM q GROUP BY 1)
    SELECT seq, CAST(sum(uses) AS BIGINT) AS uses FROM h GROUP BY 1""")
def qry6h(t):
    """The history after the query of QRY6."""
    return cand.update_history(history_parts(t)[1], qry6(t))


NAME_ID = r"/([0-9]+)"


@query("JN14", """SELECT page_id, keyword FROM pages JOIN (SELECT DISTINCT lower(n_name) AS keyword FROM nation UNION SELECT DISTINCT lower(seq) FROM benchmark_words WHERE length(seq) >= 2) k ON contains(lower(url), keyword)""")
def jn14(t):
    words = t.words("benchmark", "item_id", 2).select(F.col("seq").alias("keyword"))
    keywords = words.unionByName(t.raw("nation").select(F.col("n_name").alias("keyword")))
    return cand.keyword_match(t.raw("pages"), keywords, "page_id", "url")


@query("JN15", """SELECT page_id, acc FROM (SELECT page_id, CASE WHEN regexp_extract(url, '/([0-9]+)', 1) <> '' THEN regexp_extract(url, '/([0-9]+)', 1) ELSE url END AS acc FROM pages)
    WHERE acc IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""")
def jn15(t):
    ids = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("acc"))
    return cand.id_match(t.raw("pages").select("page_id", "url"), ids, "url", NAME_ID).select("page_id", "acc")


CLASSED = """SELECT page_id, CASE WHEN acc IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) OR contains(lower(url), 'org') THEN 'good' WHEN contains(lower(url), '/fr/') OR contains(lower(url), '/de/') THEN 'excluded' ELSE 'neutral' END AS class
    FROM (SELECT *, CASE WHEN regexp_extract(url, '/([0-9]+)', 1) <> '' THEN regexp_extract(url, '/([0-9]+)', 1) ELSE url END AS acc FROM pages)"""


def classified(t):
    ids = t.raw("supplier").select(F.col("s_suppkey").cast("string").alias("acc"))
    return cand.classify_proteins(t.raw("pages").select("page_id", "url"), "url", ids, NAME_ID, ["ORG"], ["/fr/", "/de/"]).select("page_id", "class")


@query("QRY7", CLASSED)
def qry7(t):
    return classified(t)


@query("QRY8", f"SELECT DISTINCT seq FROM (SELECT seq FROM candidates UNION ALL SELECT seq FROM benchmark_words WHERE length(seq) >= {MIN_CANDIDATE})")
def qry8(t):
    return cand.final_query(t.candidates().select("seq").unionByName(t.words("benchmark", "item_id", MIN_CANDIDATE).select("seq")))


@query("QRY9", "SELECT DISTINCT peptide, protein_id FROM hits")
def qry9(t):
    return cand.upsert_pairs(passed(t).select("peptide", "protein_id").distinct(), t.hits(), ["peptide", "protein_id"])


@query("QRY10", f"""SELECT page_id, class, score, row_number() OVER (PARTITION BY class ORDER BY score DESC, page_id) AS position FROM (SELECT c.page_id, class, length(url) AS score FROM ({CLASSED}) c JOIN pages USING (page_id))""")
def qry10(t):
    rows = classified(t).join(t.raw("pages").select("page_id", F.length("url").cast("bigint").alias("score")), "page_id")
    return cand.report_by_class(rows, "class", "score", "page_id", 64)
