"""Solutions, spectrum graph, tags and similarity."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from peakloom.functions.ordered import running_sums
from peakloom.operators import graph as gr, peptide as pep, similarity as sim, solutions as sol
from peakloom.plans.basics import CANDIDATE_MASSES, candidate_masses
from peakloom.plans.bindings import EDGE_TOL, VIEWS
from peakloom.plans.registry import query
from peakloom.session import cut_lineage

ID = "spectrum_id"
SOLS = "spectrum_id, seq, n_mass_u, charge, score"
UNIQUE = """SELECT * FROM (SELECT DISTINCT * FROM solutions) s WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT * FROM solutions) o WHERE o.spectrum_id = s.spectrum_id AND o.seq = s.seq AND abs(o.n_mass_u - s.n_mass_u) <= 7000
    AND (o.score > s.score OR (o.score = s.score AND (o.n_mass_u < s.n_mass_u OR (o.n_mass_u = s.n_mass_u AND o.charge < s.charge)))))"""
TOPK = "SELECT {SOLS}, rank FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, seq, n_mass_u, charge) AS rank FROM ({UNIQUE})) WHERE rank <= {K}"


@query("WIN9", TOPK.format(SOLS=SOLS, UNIQUE=UNIQUE, K=5))
def win9(t):
    return sol.topk_solutions(t.solutions(), 5, 7_000).select(*SOLS.split(", "), "rank")


@query("WIN10", "SELECT spectrum_id, seq, score, max(score) OVER (PARTITION BY spectrum_id) - score AS delta FROM solutions")
def win10(t):
    return sol.delta_score(t.solutions()).select(ID, "seq", "score", "delta")


@query("WIN11", """WITH RECURSIVE b AS (SELECT spectrum_id, seq, max(score) AS score FROM solutions GROUP BY 1, 2), s AS (SELECT DISTINCT seq FROM b),
    c AS (SELECT seq, i, sum(mass) OVER (PARTITION BY seq ORDER BY i) AS m FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM s) x JOIN residues ON residue = substr(x.seq, x.i, 1)),
    sh AS (SELECT x.seq, y.seq AS other, count(DISTINCT c1.i)/length(x.seq) AS share FROM s x CROSS JOIN s y JOIN c c1 ON c1.seq = x.seq JOIN c c2 ON c2.seq = y.seq AND abs(c1.m - c2.m) <= 5000 GROUP BY x.seq, y.seq),
    r AS (SELECT *, row_number() OVER w AS rank, first_value(seq) OVER w AS top_seq, first_value(score) OVER w AS top_score FROM b WINDOW w AS (PARTITION BY spectrum_id ORDER BY score DESC, seq)),
    o AS (SELECT spectrum_id, max(score) AS second, max(CASE WHEN coalesce(share, 0) < 0.8 THEN score END) AS other FROM r LEFT JOIN sh ON sh.seq = r.seq AND sh.other = r.top_seq WHERE rank > 1 GROUP BY 1)
    SELECT spectrum_id, r.seq, score, rank, CASE WHEN rank = 1 THEN score - coalesce(second, 0) ELSE score - top_score END AS delta, CASE WHEN rank = 1 THEN score - coalesce(o.other, 0) END AS delta_other FROM r LEFT JOIN o USING (spectrum_id)""")
def win11(t):
    return sol.recalibrate_hits(t.solutions(), 5_000)


@query("WIN12", f"""SELECT {SOLS} FROM (SELECT *, first_value(charge) OVER (PARTITION BY spectrum_id ORDER BY score DESC, seq, n_mass_u, charge) AS top_charge FROM solutions) WHERE charge = top_charge""")
def win12(t):
    return sol.single_charge_solutions(t.solutions()).select(*SOLS.split(", "))


@query("WIN13", f"""SELECT spectrum_id, rank, round(max((score*37 % 101)/101) OVER (PARTITION BY spectrum_id ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS cum_prob FROM ({TOPK.format(SOLS=SOLS, UNIQUE=UNIQUE, K=20)})""")
def win13(t):
    top = sol.topk_solutions(t.solutions(), 20, 7_000).withColumn("prob", (F.col("score") * 37 % 101) / 101)
    return sol.cumulative_monotone(top, "prob").select(ID, "rank", F.round("cum_prob", 6).alias("cum_prob"))


@query("WIN16", """SELECT spectrum_id, mass_u, CAST(sum(greatest(score, 0)) OVER (PARTITION BY spectrum_id ORDER BY mass_u) AS BIGINT) AS cum_score FROM graph_nodes""")
def win16(t):
    nodes, _, _ = t.graph()
    out = running_sums(nodes, [ID], F.floor(F.col("mass_u") / 4_000_000), [F.col("mass_u")], {"cum_score": F.greatest("score", F.lit(0))})
    return out.select(ID, "mass_u", "cum_score")


@query("GR1", """SELECT spectrum_id, node_u, 'fragment' AS kind, ion, peak_u, intensity FROM fragments UNION ALL SELECT spectrum_id, node_u, kind, NULL AS ion, NULL AS peak_u, CAST(0 AS BIGINT) AS intensity FROM terminals""")
def gr1(t):
    return gr.spectrum_nodes(t.strong(), t.spectra())


@query("GR2", "SELECT spectrum_id, mass_u, score, n_frags FROM merged_nodes")
def gr2(t):
    return gr.merge_close_nodes(gr.fragment_nodes(t.strong(), t.spectra(), t.peak_parts()), EDGE_TOL)[0]


@query("GR3", """WITH g AS MATERIALIZED (SELECT * FROM graph_nodes), w AS (SELECT spectrum_id, residue, pm_u - 190184 - mass AS want_u FROM spectra CROSS JOIN residues WHERE residue IN ('K', 'R')),
    b AS MATERIALIZED (SELECT spectrum_id, residue, mass_u FROM (SELECT w.*, n.mass_u, row_number() OVER (PARTITION BY w.spectrum_id, w.residue ORDER BY abs(n.mass_u - want_u), n.mass_u) AS rn FROM w JOIN g n ON n.spectrum_id = w.spectrum_id AND abs(n.mass_u - want_u) <= 7500) WHERE rn = 1),
    f AS (SELECT DISTINCT spectrum_id, mass_u, TRUE AS flag FROM b)
    SELECT spectrum_id, mass_u, score, n_frags, coalesce(flag, FALSE) AS is_digest FROM g LEFT JOIN f USING (spectrum_id, mass_u)
    UNION ALL SELECT spectrum_id, want_u, 0, 0, TRUE FROM w ANTI JOIN b USING (spectrum_id, residue)""")
def gr3(t):
    nodes, _, _ = t.graph()
    return gr.digest_nodes(nodes, t.spectra(), EDGE_TOL)


@query("GR4", "SELECT spectrum_id, from_u, to_u, label, n_res, err_u, to_score FROM graph_edges")
def gr4(t):
    return t.graph()[2]


@query("GR4L", f"""WITH g AS MATERIALIZED (SELECT * FROM graph_nodes), e AS MATERIALIZED (SELECT * FROM graph_edges),
    c AS (SELECT x.residue || y.residue || z.residue AS label, x.mass + y.mass + z.mass AS mass FROM edge_order x JOIN edge_order y ON x.i <= y.i JOIN edge_order z ON y.i <= z.i),
    o AS (SELECT spectrum_id, from_u AS mass_u, string_agg(DISTINCT label, '') AS out FROM e GROUP BY 1, 2), t AS (SELECT spectrum_id, to_u AS mass_u, string_agg(DISTINCT label, '') AS came FROM e GROUP BY 1, 2),
    a AS (SELECT g.*, coalesce(out, '') AS out FROM g LEFT JOIN o USING (spectrum_id, mass_u)),
    p AS (SELECT a.spectrum_id, a.mass_u AS from_u, b.mass_u AS to_u, b.score AS to_score, out, a.n_frags = 0 OR b.n_frags = 0 AS loose, b.mass_u - a.mass_u AS gap FROM a JOIN g b ON a.spectrum_id = b.spectrum_id AND b.mass_u - a.mass_u BETWEEN 1700000 AND 5600000),
    r AS (SELECT *, gap - mass AS err_u FROM p JOIN c ON c.mass BETWEEN gap - {EDGE_TOL * 3 // 2} AND gap + {EDGE_TOL * 3 // 2} WHERE translate(label, out, '') = label),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, from_u, label ORDER BY abs(err_u) > {EDGE_TOL // 2}, to_score DESC, to_u) AS rn FROM r) WHERE rn = 1 AND (loose OR abs(err_u) <= {EDGE_TOL}))
    SELECT w.spectrum_id, from_u, to_u, label, CAST(3 AS INTEGER) AS n_res, err_u, to_score FROM w LEFT JOIN t ON t.spectrum_id = w.spectrum_id AND t.mass_u = w.to_u WHERE translate(label, coalesce(came, ''), '') = label""")
def gr4_long(t):
    nodes, edges = t.stored_graph()
    return gr.long_edges(nodes, edges, EDGE_TOL)


PRUNED = """SELECT n.* FROM graph_nodes n JOIN spectra s USING (spectrum_id) WHERE n_frags = 0 OR score > CASE WHEN s.charge > 2 THEN -4 ELSE -12 END + CASE WHEN s.pm_u > 20000000 THEN 2 ELSE 0 END"""


@query("GR5", f"""WITH k AS ({PRUNED}) SELECT e.* FROM graph_edges e SEMI JOIN k a ON a.spectrum_id = e.spectrum_id AND a.mass_u = e.from_u SEMI JOIN k b ON b.spectrum_id = e.spectrum_id AND b.mass_u = e.to_u""")
def gr5(t):
    nodes, _, edges = t.graph()
    return gr.prune_nodes(nodes, edges, t.spectra())[1]


@query("GR6", """WITH m AS (SELECT r.spectrum_id, r.ion, r.peak_u, r.pm_u, n.mass_u FROM fragment_runs r JOIN merged_nodes n USING (spectrum_id, run))
    SELECT DISTINCT b.spectrum_id, least(b.mass_u, y.mass_u) AS lo_u, greatest(b.mass_u, y.mass_u) AS hi_u FROM m b JOIN m y USING (spectrum_id, peak_u) WHERE b.ion = 'b' AND y.ion = 'y' AND b.mass_u <> y.mass_u
    AND abs(b.mass_u + y.mass_u - b.pm_u + 10073) <= 7500""")
def gr6(t):
    return gr.forbidden_pairs(t.graph()[1], EDGE_TOL)


def tags_sql(k: int, n: int) -> str:
    joins = " ".join(
        f"JOIN hops h{i} ON h{i}.spectrum_id = n.spectrum_id AND h{i}.from_u = {'n.mass_u' if i == 1 else f'h{i - 1}.to_u'}" for i in range(1, k + 1)
    )
    tag = " || ".join(f"h{i}.label" for i in range(1, k + 1))
    gain = " + ".join(f"h{i}.gain" for i in range(1, k + 1))
    nodes = ", ".join(f"h{i}.to_u" for i in range(1, k + 1))
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, tag, nodes) AS rank FROM (
    SELECT n.spectrum_id, n.mass_u AS start_u, h{k}.to_u AS end_u, n.score + {gain} AS score, {tag} AS tag, [n.mass_u, {nodes}] AS nodes FROM graph_nodes n {joins})) WHERE rank <= {n}"""


@query("GR7", f"SELECT spectrum_id, tag, start_u, end_u, score, rank FROM ({tags_sql(3, 20)})")
def gr7(t):
    nodes, edges = t.stored_graph()
    return gr.tags(nodes, edges, 3, 20, EDGE_TOL).select(ID, "tag", "start_u", "end_u", "score", "rank")


FORBIDDEN = """SELECT DISTINCT b.spectrum_id, least(b.mass_u, y.mass_u) AS lo_u, greatest(b.mass_u, y.mass_u) AS hi_u FROM m b JOIN m y USING (spectrum_id, peak_u)
    WHERE b.ion = 'b' AND y.ion = 'y' AND b.mass_u <> y.mass_u AND abs(b.mass_u + y.mass_u - b.pm_u + 10073) <= 7500"""


def beam_sql(length: int, beam: int, shortest: int = 3) -> str:
    """Common table expressions of the beam search, one for each hop, and ``paths``."""
    hops = [
        f"""p{i} AS MATERIALIZED (SELECT * FROM (SELECT p.spectrum_id, h.to_u AS end_u, p.score + h.gain - 25*len(list_intersect(p.nodes, coalesce(v.rivals, []))) AS score, p.tag || h.label AS tag, list_append(p.nodes, h.to_u) AS nodes
        FROM p{i - 1} p JOIN hs h ON h.spectrum_id = p.spectrum_id AND h.from_u = p.end_u LEFT JOIN rivals v ON v.spectrum_id = h.spectrum_id AND v.next_u = h.to_u)
        QUALIFY row_number() OVER (PARTITION BY spectrum_id, end_u ORDER BY score DESC, tag, nodes) <= {beam})"""
        for i in range(1, length + 1)
    ]
    ends = " UNION ALL ".join(f"SELECT *, CAST({i} AS INTEGER) AS n_res FROM p{i}" for i in range(shortest, length + 1))
    return f"""m AS (SELECT r.spectrum_id, r.ion, r.peak_u, r.pm_u, n.mass_u FROM fragment_runs r JOIN merged_nodes n USING (spectrum_id, run)), hs AS MATERIALIZED (SELECT * FROM hops), fp AS MATERIALIZED ({FORBIDDEN}),
        rivals AS MATERIALIZED (SELECT spectrum_id, next_u, list(other) AS rivals FROM (SELECT spectrum_id, lo_u AS next_u, hi_u AS other FROM fp UNION ALL SELECT spectrum_id, hi_u, lo_u FROM fp) GROUP BY 1, 2),
        p0 AS MATERIALIZED (SELECT spectrum_id, mass_u AS end_u, score, '' AS tag, [mass_u] AS nodes FROM graph_nodes), {', '.join(hops)}, paths AS ({ends})"""


@query("GR8", f"WITH {beam_sql(6, 3)} SELECT spectrum_id, tag, nodes[1] AS start_u, end_u, score, n_res FROM paths")
def gr8(t):
    _, members, _ = t.graph()
    nodes, edges = t.stored_graph()
    paths = gr.extend_paths(nodes, edges, gr.forbidden_pairs(members, EDGE_TOL), EDGE_TOL, 6, 3)
    return paths.select(ID, "tag", F.element_at("nodes", 1).alias("start_u"), "end_u", "score", "n_res")


def masses_sql(n: int, near: int) -> str:
    """The same search in graphs of all candidate masses, merged by sequence and start."""
    names = ["fragments", "fragment_runs", "merged_nodes", "terminals", "graph_nodes", "graph_edges", "hops"]

    def of_candidates(sql: str) -> str:
        for name in [*names, "spectra", "strong_set"]:
            sql = re.sub(rf"\b{name}\b", f"cand_{name}", sql)
        return sql

    views = ", ".join(f"cand_{v} AS MATERIALIZED ({of_candidates(VIEWS[v])})" for v in names)
    return f"""WITH masses AS ({CANDIDATE_MASSES}), cand_spectra AS (SELECT spectrum_id*16 + idx AS spectrum_id, cand_u AS pm_u, charge FROM masses),
        cand_strong_set AS MATERIALIZED (SELECT s.spectrum_id*16 + idx AS spectrum_id, mass_u, intensity FROM strong_set s JOIN masses USING (spectrum_id)), {views}, {of_candidates(beam_sql(4, 2))},
        f AS MATERIALIZED (SELECT spectrum_id // 16 AS spectrum_id, CAST(spectrum_id % 16 AS INTEGER) AS idx, tag, nodes[1] AS start_u, end_u, score, n_res FROM paths),
        u AS (SELECT * FROM f x WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.spectrum_id = x.spectrum_id AND o.tag = x.tag AND abs(o.start_u - x.start_u) <= {near}
          AND (o.score > x.score OR (o.score = x.score AND (o.start_u < x.start_u OR (o.start_u = x.start_u AND o.idx < x.idx))))))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY score DESC, tag, start_u, idx) AS rank FROM u) WHERE rank <= {n}"""


@query("GR8M", masses_sql(20, EDGE_TOL))
def gr8_masses(t):
    return gr.paths_over_masses(t.strong(), candidate_masses(t), EDGE_TOL, 4, 2, 20, EDGE_TOL, parts=t.peak_parts())


@query("GR9", f"""WITH p AS ({tags_sql(4, 30)}), sp AS (SELECT spectrum_id, rank AS path_id, tag, nodes, i, i + n AS e, n FROM p, range(0, 3) AS a(i), range(2, 4) AS b(n) WHERE i + n <= 4),
    ok AS (SELECT spectrum_id, path_id, tag, nodes, i, min(n) AS n FROM sp SEMI JOIN (SELECT spectrum_id, mass_u FROM graph_nodes WHERE n_frags >= 1 OR mass_u = 0) r ON r.spectrum_id = sp.spectrum_id AND r.mass_u = sp.nodes[sp.e + 1] GROUP BY ALL)
    SELECT spectrum_id, path_id, CAST(i AS INTEGER) AS start_pos, CAST(n AS INTEGER) AS n_res, substr(tag, i + 1, n) AS sub_tag, nodes[i + 1] AS start_u, nodes[i + n + 1] AS end_u FROM ok""")
def gr9(t):
    nodes, edges = t.stored_graph()
    paths = gr.tags(nodes, edges, 4, 30, EDGE_TOL).select(ID, F.col("rank").alias("path_id"), "tag", "nodes")
    return gr.split_paths(paths, nodes.filter("n_frags >= 1 or mass_u = 0"), 2, 3)


@query("GR10", f"""WITH t AS (SELECT spectrum_id, tag, score, start_u, end_u FROM ({tags_sql(3, 10)}) UNION ALL SELECT spectrum_id, tag, score, start_u, end_u FROM ({tags_sql(4, 15)})),
    c AS (SELECT DISTINCT a.spectrum_id, a.tag FROM t a JOIN t b ON a.spectrum_id = b.spectrum_id AND length(b.tag) < length(a.tag) AND contains(a.tag, b.tag)) SELECT * FROM t ANTI JOIN c USING (spectrum_id, tag)""")
def gr10(t):
    nodes, edges = t.stored_graph()
    return gr.tag_table(nodes, edges, {3: 10, 4: 15}, EDGE_TOL)


@query("GR11", "SELECT spectrum_id, CAST(round(mass_u/10000) AS BIGINT) AS mass_da, score FROM graph_nodes WHERE score > 0")
def gr11(t):
    nodes, _, _ = t.graph()
    return nodes.filter("score > 0").select(ID, F.round(F.col("mass_u") / 10_000).cast("bigint").alias("mass_da"), "score")


@query("GR12", f"""WITH t AS ({tags_sql(3, 10)}), m AS (SELECT spectrum_id, list(pm) AS pms FROM (SELECT spectrum_id, sum(mass) OVER (PARTITION BY spectrum_id ORDER BY cut) AS pm FROM peptide_residues) GROUP BY 1)
    SELECT t.spectrum_id, rank, score, start_u AS n_gap_u, CASE WHEN pm_u - 190184 - end_u < 240000 THEN 0 ELSE pm_u - 190184 - end_u END AS c_gap_u, pm_u, charge, tag,
    position(translate(tag, 'IK', 'LQ') IN translate(peptide, 'IK', 'LQ')) > 0 AND ((start_u = 0 AND position(translate(tag, 'IK', 'LQ') IN translate(peptide, 'IK', 'LQ')) = 1) OR len(list_filter(pms, lambda x: abs(x - start_u) < 60000)) > 0) AS correct
    FROM t JOIN spectra USING (spectrum_id) JOIN m USING (spectrum_id)""")
def gr12(t):
    nodes, edges = t.stored_graph()
    return gr.solutions_report(gr.tags(nodes, edges, 3, 10, EDGE_TOL), t.spectra(), pep.is_correct)


# --- similarity -------------------------------------------------------------------

HALF, TOP_TOL, SIM_TOL = 5_000, 65_000, 50_000
TOPS = "SELECT spectrum_id, mass_u, mz_u, charge FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id ORDER BY intensity DESC, mass_u) AS rn FROM peaks) JOIN spectra USING (spectrum_id) WHERE rn <= 5"
PAIRS = f"""SELECT DISTINCT x.spectrum_id AS a, y.spectrum_id AS b FROM ({TOPS}) x JOIN ({TOPS}) y ON x.charge = y.charge AND x.spectrum_id < y.spectrum_id AND abs(x.mz_u - y.mz_u) <= {HALF} AND abs(x.mass_u - y.mass_u) <= {TOP_TOL}"""
COSINE = f"""SELECT a, b, n_matched, least(1.0, dot/sqrt(CAST(na.norm AS DOUBLE)*nb.norm)) AS similarity FROM (SELECT a, b, sum(ia*ib) AS dot, count(*) AS n_matched FROM (
    SELECT *, row_number() OVER (PARTITION BY a, b, ma ORDER BY abs(ma - mb), mb) AS ra, row_number() OVER (PARTITION BY a, b, mb ORDER BY abs(ma - mb), ma) AS rb FROM (
    SELECT a, b, x.mass_u AS ma, x.intensity AS ia, y.mass_u AS mb, y.intensity AS ib FROM ({PAIRS}) JOIN peaks x ON x.spectrum_id = a JOIN peaks y ON y.spectrum_id = b AND abs(x.mass_u - y.mass_u) <= {SIM_TOL}))
    WHERE ra = 1 AND rb = 1 GROUP BY a, b) JOIN (SELECT spectrum_id AS a, sum(intensity*intensity) AS norm FROM peaks GROUP BY 1) na USING (a) JOIN (SELECT spectrum_id AS b, sum(intensity*intensity) AS norm FROM peaks GROUP BY 1) nb USING (b)"""
MIN_SIM = 0.25
SIMILAR = f"SELECT a, b, similarity FROM ({COSINE}) WHERE similarity >= {MIN_SIM}"
CLUSTERS = f"""links AS ({SIMILAR}), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT a AS node, a AS root FROM both_ways UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node),
    comp AS (SELECT node AS spectrum_id, min(root) AS cluster_id FROM reach GROUP BY 1), members AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM comp)"""


def similar(t, forest=False, copies=None):
    return sim.similar_pairs(t.spectra(), t.peak_list(), HALF, TOP_TOL, SIM_TOL, MIN_SIM, forest, copies)


def members(t):
    return sim.clusters(similar(t, forest=True))


@query("SIM1", f"SELECT a, b, n_matched, round(similarity, 6) AS similarity FROM ({COSINE})")
def sim1(t):
    return sim.scored_pairs(t.spectra(), t.peak_list(), HALF, TOP_TOL, SIM_TOL).withColumn("similarity", F.round("similarity", 6))


@query("SIM2", PAIRS)
def sim2(t):
    return sim.candidate_pairs(t.spectra(), t.peak_list(), HALF, TOP_TOL)


@query("SIM3", f"SELECT x.spectrum_id, count(*) - 1 AS n_neighbours FROM spectra x JOIN spectra y ON x.charge = y.charge AND abs(x.mz_u - y.mz_u) <= {HALF} GROUP BY 1")
def sim3(t):
    return sim.neighbour_counts(t.spectra(), HALF)


@query("SIM4", f"SELECT a, b, round(similarity, 6) AS similarity FROM ({SIMILAR})")
def sim4(t):
    return similar(t).withColumn("similarity", F.round("similarity", 6))


@query("SIM5", f"WITH RECURSIVE {CLUSTERS} SELECT spectrum_id, cluster_id, size FROM members")
def sim5(t):
    return members(t)


@query("SIM6", f"""WITH RECURSIVE {CLUSTERS}, j AS (SELECT m.*, mass_u, intensity FROM members m JOIN peaks USING (spectrum_id)), r AS (SELECT *, sum(start) OVER (PARTITION BY cluster_id ORDER BY mass_u) AS run FROM (
    SELECT *, CASE WHEN mass_u - lag(mass_u) OVER (PARTITION BY cluster_id ORDER BY mass_u) <= 20000 THEN 0 ELSE 1 END AS start FROM j))
    SELECT cluster_id, CAST(sum(mass_u*intensity)//sum(intensity) AS BIGINT) AS mass_u, CAST(sum(intensity) AS BIGINT) AS intensity, count(DISTINCT spectrum_id) AS n_members FROM r GROUP BY cluster_id, run, size HAVING count(DISTINCT spectrum_id) >= size*0.5""")
def sim6(t):
    return sim.consensus_spectrum(members(t), t.peak_list(), 20_000, 0.5)


@query("SIM7", f"""WITH RECURSIVE {CLUSTERS}, c AS (SELECT cluster_id, peptide, count(*) AS n FROM members JOIN annotated USING (spectrum_id) GROUP BY 1, 2), t AS (SELECT cluster_id, CAST(sum(n) AS BIGINT) AS n_annotated FROM c GROUP BY 1)
    SELECT cluster_id, peptide, n, n_annotated FROM c JOIN t USING (cluster_id) WHERE n >= n_annotated*0.3""")
def sim7(t):
    return sim.majority_annotation(members(t), t.annotated().select(ID, "peptide"), 0.3)


@query("SIM8", f"""WITH RECURSIVE {CLUSTERS}, s AS (SELECT spectrum_id, CAST(sum(CAST(round(similarity*1000000) AS BIGINT)) AS BIGINT) AS sim_sum FROM (SELECT a AS spectrum_id, similarity FROM links UNION ALL SELECT b, similarity FROM links) GROUP BY 1)
    SELECT cluster_id, spectrum_id AS representative, sim_sum FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim_sum DESC, spectrum_id) AS rn FROM members JOIN s USING (spectrum_id)) WHERE rn = 1""")
def sim8(t):
    copies = cut_lineage(sim.fold_copies(t.spectra(), t.peak_list()))
    pairs = cut_lineage(similar(t, forest=True, copies=copies))
    return sim.representatives(sim.clusters(pairs), pairs, copies)
