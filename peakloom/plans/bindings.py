"""The domain tables, bound to the given parquet tables, in Spark and in SQL.

``Tables`` gives DataFrames; ``VIEWS`` gives the same tables as SQL, from which
``with_views`` builds the WITH prefix that a query text needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from peakloom.functions import mass, text
from peakloom.functions.ordered import dealt, spread
from peakloom.session import cut_lineage
from peakloom.operators import graph, peaks, peptide as pep

#: Shortest candidate sequence of a homology query.
MIN_CANDIDATE = 7
#: Spectra that a task lays out to cuts and theoretical ions.
SPECTRA_IN_PART = 25_000
#: Peaks that a task sorts.
PEAKS_IN_PART = 500_000
RESIDUE_CLASS = "ACDEFGHIKLMNPQRSTVWY"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spectra(self) -> DataFrame:
        mz = F.round(F.col("p_retailprice") * 10000).cast("bigint")
        charge = (F.lit(1) + F.col("p_size") % 3).cast("int")
        return self.raw("part").select(
            F.col("p_partkey").alias("spectrum_id"),
            mz.alias("mz_u"),
            charge.alias("charge"),
            mass.precursor_mass(mz, charge).cast("bigint").alias("pm_u"),
            F.col("p_brand").alias("file_idx"),
            F.col("p_type").alias("file_type"),
            F.when(F.col("p_size") % 7 != 0, (F.col("p_size") * 20).cast("bigint")).alias("sqs"),
            F.regexp_replace(F.upper("p_name"), f"[^{RESIDUE_CLASS}]", "").alias("peptide"),
        )

    def peaks(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_partkey").alias("spectrum_id"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("mass_u"),
            F.col("l_quantity").cast("bigint").alias("intensity"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("pos"),
        )

    def peak_list(self) -> DataFrame:
        return self.peaks().select("spectrum_id", "mass_u", "intensity")

    def peak_parts(self) -> int:
        """Parts of a table of peaks, by their count: a task sorts the same as the table grows."""
        return max(self.spark.sparkContext.defaultParallelism, self.raw("lineitem").count() // PEAKS_IN_PART + 1)

    def scans(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("row_id"),
            F.col("event_type").alias("generation"),
            F.col("user_id").alias("file_idx"),
            F.floor("value").cast("bigint").alias("scan"),
            F.col("ts"),
        )

    def hits(self) -> DataFrame:
        return self.raw("events").select(
            (F.col("user_id") * 2 + (F.col("event_type") == "error").cast("bigint")).alias("protein_id"),
            F.col("props").alias("peptide"),
            F.floor(F.col("value") / F.when(F.col("event_type") == "error", 2).otherwise(1)).cast("bigint").alias("score"),
            (F.col("event_type") == "error").alias("is_decoy"),
        )

    def proteins(self) -> DataFrame:
        docs = spread(self.raw("documents").select("doc_id", "source", "text"), "doc_id")
        return docs.select(
            F.col("doc_id").alias("protein_id"), F.col("source").alias("name"), text.letters(F.col("text")).alias("seq")
        )

    def words(self, table: str, key: str, min_len: int) -> DataFrame:
        return self.raw(table).select(
            F.col(key).alias("set_id"), F.posexplode(text.words(F.col("text"), min_len)).alias("word_pos", "seq")
        )

    def candidates(self) -> DataFrame:
        """Every word of at least MIN_CANDIDATE letters of a conversation is a candidate sequence."""
        return self.raw("conversations").select(
            F.col("conv_id").alias("set_id"),
            F.length("text").cast("bigint").alias("base_score"),
            F.explode(text.words(F.col("text"), MIN_CANDIDATE)).alias("seq"),
        ).select("set_id", "seq", (F.col("base_score") % 97 + F.length("seq")).cast("bigint").alias("score"))

    def labelled(self) -> DataFrame:
        return self.raw("labels").join(self.raw("documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")

    def quality(self) -> DataFrame:
        """Quality score per spectrum and candidate charge, in percent."""
        return (
            self.raw("lineitem")
            .groupBy(F.col("l_partkey").alias("spectrum_id"), (F.lit(1) + F.col("l_linenumber") % 3).cast("int").alias("charge"))
            .agg(F.max(F.round((F.col("l_tax") + F.col("l_discount")) * 100).cast("bigint")).alias("prob"))
        )

    def annotated(self) -> DataFrame:
        return self.spectra().filter(F.length("peptide") >= 4)

    def cuts(self) -> DataFrame:
        spectra = dealt(self.annotated().select("spectrum_id", "peptide"), "spectrum_id", SPECTRA_IN_PART, self.raw("part"))
        return pep.cut_masses(spectra, ["spectrum_id", "peptide"])

    def solutions(self) -> DataFrame:
        """Scored sequence solutions per spectrum."""
        rows = (
            self.raw("lineitem")
            .join(self.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(self.raw("customer"), F.col("c_custkey") == F.col("o_custkey"))
        )
        return rows.select(
            F.col("l_partkey").alias("spectrum_id"),
            F.regexp_replace(F.upper(F.concat("c_mktsegment", "o_orderpriority")), f"[^{RESIDUE_CLASS}]", "").alias("seq"),
            (F.round(F.col("l_discount") * 100) * 3000).cast("bigint").alias("n_mass_u"),
            (F.lit(1) + F.col("l_linenumber") % 3).cast("int").alias("charge"),
            (F.col("l_quantity") * 100 + F.round(F.col("l_tax") * 100)).cast("bigint").alias("score"),
        )

    def samples(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("sample_id"),
            F.col("user_id").alias("grp"),
            (F.col("event_type") == "error").cast("int").alias("label"),
            "event_type",
            F.floor("value").cast("bigint").alias("v"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("k"),
        )

    def features(self) -> DataFrame:
        one = lambda name, value: F.struct(F.lit(name).alias("feature"), value.cast("bigint").alias("value"))
        rows = F.array(
            one("value", F.col("v")), one("k", F.col("k")), one("high", F.col("k") >= 90), one("click", F.col("event_type") == "click")
        )
        return self.samples().select("sample_id", "label", F.inline(rows))

    def weighted(self) -> DataFrame:
        return self.samples().select("sample_id", "label", (F.lit(1) + F.col("v") % 5).cast("double").alias("weight"))

    def sums(self) -> DataFrame:
        return self.spectra().select("spectrum_id", "charge", (F.col("pm_u") + mass.PROTON).alias("sum_u"))

    def strong(self) -> DataFrame:
        return peaks.strong_peaks(self.peak_list(), 2_000_000, 3, 5_000, self.peak_parts())

    def ion_matches(self, observed: bool = False) -> DataFrame:
        """Theoretical ions with their peaks; the mass range of a spectrum is joined before its ions are laid out."""
        ranges = peaks.peak_range(self.peak_list()).select("spectrum_id", "lo_u", "hi_u")
        spectra = self.annotated().select("spectrum_id", "peptide").join(ranges, "spectrum_id")
        cuts = pep.cut_masses(dealt(spectra, "spectrum_id", SPECTRA_IN_PART, self.raw("part")), ["spectrum_id", "peptide", "lo_u", "hi_u"])
        return peaks.match_ions(pep.expected_ions(cuts), self.peak_list(), ION_TOL, observed)

    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, members, edges) of the spectrum graph."""
        merged, members = graph.merge_close_nodes(graph.fragment_nodes(self.strong(), self.spectra(), self.peak_parts()), EDGE_TOL)
        nodes = graph.with_terminals(merged, self.spectra())
        return nodes, members, graph.node_edges(nodes, EDGE_TOL)

    def stored_graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges written once to the shared folder, for jobs that hop over them repeatedly."""
        nodes, _, _ = self.graph()
        nodes = cut_lineage(nodes)
        return nodes, cut_lineage(graph.node_edges(nodes, EDGE_TOL))

    def expected(self, ions: list[str] | None = None) -> DataFrame:
        return pep.expected_ions(self.cuts(), ions)


def _values(rows: list[tuple]) -> str:
    def lit(x):
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return "TRUE" if x else "FALSE"
        return f"'{x}'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


# Tolerances of the test bindings; wide, because the given tables are no real spectra.
ION_TOL = 30_000
EDGE_TOL = 5_000


TARGET_FDR = 0.05


def levels_sql(source: str, score: str) -> str:
    return f"""SELECT score, n_target, n_decoy, max(d/a) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fdr FROM (
        SELECT *, sum(n_decoy) OVER (ORDER BY score DESC) AS d, sum(n_target + n_decoy) OVER (ORDER BY score DESC) AS a FROM (
        SELECT {score} AS score, count(*) FILTER (WHERE NOT is_decoy) AS n_target, count(*) FILTER (WHERE is_decoy) AS n_decoy FROM {source} GROUP BY 1))"""


def edges_sql(doubles: bool, nodes: str = "peaks", score: str = "intensity") -> str:
    """Best target per node and step: within half the tolerance, else within one and a half."""

    def best(source: str) -> str:
        return f"""SELECT spectrum_id, from_u, to_u, label, n_res, err_u, to_score FROM (
            SELECT a.spectrum_id, a.mass_u AS from_u, b.mass_u AS to_u, r.label, r.n_res, b.mass_u - a.mass_u - r.mass AS err_u, b.{score} AS to_score,
            row_number() OVER (PARTITION BY a.spectrum_id, a.mass_u, r.label ORDER BY abs(b.mass_u - a.mass_u - r.mass) > {EDGE_TOL // 2}, b.{score} DESC, b.mass_u) AS rn
            FROM {nodes} a JOIN {nodes} b ON a.spectrum_id = b.spectrum_id AND b.mass_u - a.mass_u BETWEEN 500000 AND 3800000
            JOIN ({source}) r ON abs(b.mass_u - a.mass_u - r.mass) <= {EDGE_TOL * 3 // 2}) WHERE rn = 1"""

    one = best("SELECT residue AS label, CAST(1 AS INTEGER) AS n_res, mass FROM edge_residues")
    if not doubles:
        return one
    two = best(
        "SELECT x.residue || y.residue AS label, CAST(2 AS INTEGER) AS n_res, x.mass + y.mass AS mass FROM edge_order x JOIN edge_order y ON x.i <= y.i"
    )
    return f"""WITH e1 AS ({one}), e2 AS ({two}) SELECT * FROM e1 UNION ALL SELECT * FROM e2 WHERE NOT EXISTS (SELECT 1 FROM e1
        WHERE e1.spectrum_id = e2.spectrum_id AND e1.from_u = e2.from_u AND e1.label IN (substr(e2.label, 1, 1), substr(e2.label, 2, 1))
        AND e1.label NOT IN ('P', 'G', 'H', 'S'))"""


VIEWS = {
    "edge_order": "SELECT residue, CAST(mass AS BIGINT) AS mass, i FROM (VALUES "
    + _values([(r, m, i) for i, (r, m) in enumerate(mass.EDGE_RESIDUES.items())])
    + ") AS v(residue, mass, i)",
    "residues": "SELECT residue, CAST(mass AS BIGINT) AS mass FROM (VALUES "
    + _values(list(mass.RESIDUE_MASS.items()))
    + ") AS v(residue, mass)",
    "edge_residues": "SELECT residue, mass FROM residues WHERE residue <> 'I'",
    "ions": "SELECT ion, orientation, CAST(ion_charge AS INTEGER) AS ion_charge, CAST(offset_u AS BIGINT) AS offset_u, parent, strong FROM (VALUES "
    + _values([(n, *v) for n, v in mass.IONS.items()])
    + ") AS v(ion, orientation, ion_charge, offset_u, parent, strong)",
    "spectra": f"""SELECT *, CAST(mz_u*charge-(charge-1)*{mass.PROTON} AS BIGINT) AS pm_u FROM (
        SELECT p_partkey AS spectrum_id, CAST(round(p_retailprice*10000) AS BIGINT) AS mz_u,
        CAST(1 + p_size % 3 AS INTEGER) AS charge, p_brand AS file_idx, p_type AS file_type,
        CASE WHEN p_size % 7 <> 0 THEN CAST(p_size*20 AS BIGINT) END AS sqs,
        regexp_replace(upper(p_name), '[^{RESIDUE_CLASS}]', '', 'g') AS peptide FROM part)""",
    "peaks": """SELECT l_partkey AS spectrum_id, CAST(round(l_extendedprice*100) AS BIGINT) AS mass_u,
        CAST(l_quantity AS BIGINT) AS intensity, CAST(l_orderkey*10+l_linenumber AS BIGINT) AS pos FROM lineitem""",
    "scans": """SELECT event_id AS row_id, event_type AS generation, user_id AS file_idx,
        CAST(floor(value) AS BIGINT) AS scan, ts FROM events""",
    "hits": """SELECT user_id*2 + CAST(event_type = 'error' AS BIGINT) AS protein_id, props AS peptide,
        CAST(floor(value / CASE WHEN event_type = 'error' THEN 2 ELSE 1 END) AS BIGINT) AS score, event_type = 'error' AS is_decoy FROM events""",
    "proteins": """SELECT doc_id AS protein_id, source AS name,
        upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents""",
    "conversation_words": """SELECT conv_id AS set_id, length(text) AS base_score,
        unnest(string_split(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS seq FROM conversations""",
    "candidates": f"""SELECT set_id, seq, CAST(base_score % 97 + length(seq) AS BIGINT) AS score
        FROM conversation_words WHERE length(seq) >= {MIN_CANDIDATE}""",
    "benchmark_words": """SELECT item_id AS set_id,
        unnest(string_split(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS seq FROM benchmark""",
    "document_words": """SELECT doc_id AS set_id,
        unnest(string_split(upper(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')) AS seq FROM documents""",
    "hit_levels": levels_sql("hits", "score"),
    "passed": f"SELECT * FROM hits WHERE score IN (SELECT score FROM hit_levels WHERE fdr <= {TARGET_FDR})",
    "protein_scores": """SELECT *, total - (n_peptides - 1)*35 - greatest(n_peptides - 5, 0)*3 AS adj_score FROM (SELECT protein_id, is_decoy,
        CAST(sum(score) AS BIGINT) AS total, count(*) AS n_peptides, max(score) AS best_score FROM passed GROUP BY 1, 2)""",
    "labelled": "SELECT labels.*, n_chars, lang, source FROM labels JOIN documents USING (doc_id)",
    "quality": """SELECT l_partkey AS spectrum_id, CAST(1 + l_linenumber % 3 AS INTEGER) AS charge,
        max(CAST(round((l_tax + l_discount)*100) AS BIGINT)) AS prob FROM lineitem GROUP BY 1, 2""",
    "annotated": "SELECT * FROM spectra WHERE length(peptide) >= 4",
    "peptide_residues": """SELECT spectrum_id, peptide, i AS cut, substr(peptide, i, 1) AS residue, mass FROM (
        SELECT spectrum_id, peptide, unnest(range(1, length(peptide) + 1)) AS i FROM annotated) a
        JOIN residues ON residues.residue = substr(a.peptide, a.i, 1)""",
    "cuts": """SELECT spectrum_id, peptide, CAST(cut AS INTEGER) AS cut, CAST(cut_u AS BIGINT) AS cut_u, CAST(total_u AS BIGINT) AS total_u FROM (
        SELECT spectrum_id, peptide, cut, sum(mass) OVER (PARTITION BY spectrum_id ORDER BY cut) AS cut_u,
        sum(mass) OVER (PARTITION BY spectrum_id) AS total_u FROM peptide_residues) WHERE cut < length(peptide)""",
    "expected": """SELECT cuts.*, ion, orientation, ion_charge, parent, strong,
        ((CASE WHEN orientation = 'prefix' THEN cut_u ELSE total_u - cut_u END) + offset_u) // ion_charge AS expected_u
        FROM cuts CROSS JOIN ions""",
    "solutions": f"""SELECT l_partkey AS spectrum_id, regexp_replace(upper(c_mktsegment || o_orderpriority), '[^{RESIDUE_CLASS}]', '', 'g') AS seq,
        CAST(round(l_discount*100)*3000 AS BIGINT) AS n_mass_u, CAST(1 + l_linenumber % 3 AS INTEGER) AS charge, CAST(l_quantity*100 + round(l_tax*100) AS BIGINT) AS score
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""",
    "samples": """SELECT event_id AS sample_id, user_id AS grp, CAST(event_type = 'error' AS INTEGER) AS label, event_type, CAST(floor(value) AS BIGINT) AS v,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""",
    "features": """SELECT sample_id, label, 'value' AS feature, v AS value FROM samples UNION ALL SELECT sample_id, label, 'k' AS feature, k AS value FROM samples
        UNION ALL SELECT sample_id, label, 'high' AS feature, CAST(k >= 90 AS BIGINT) AS value FROM samples UNION ALL SELECT sample_id, label, 'click' AS feature, CAST(event_type = 'click' AS BIGINT) AS value FROM samples""",
    "weighted": "SELECT sample_id, label, CAST(1 + v % 5 AS DOUBLE) AS weight FROM samples",
    "sums": "SELECT spectrum_id, charge, pm_u + 10073 AS sum_u FROM spectra",
    "peak_range": "SELECT spectrum_id, min(mass_u) AS lo_u, max(mass_u) AS hi_u, count(*) AS n_peaks FROM peaks GROUP BY 1",
    "ion_base": f"""SELECT * FROM (SELECT e.spectrum_id, e.cut, e.ion, e.orientation, e.ion_charge, e.expected_u, p.mass_u, p.intensity,
        row_number() OVER (PARTITION BY e.spectrum_id, e.cut, e.ion ORDER BY p.intensity*(2*{ION_TOL} - abs(p.mass_u - e.expected_u)) DESC, p.mass_u) AS rn
        FROM expected e JOIN peaks p ON p.spectrum_id = e.spectrum_id AND p.mass_u BETWEEN e.expected_u - {ION_TOL} AND e.expected_u + {ION_TOL}
        WHERE e.parent IS NULL) WHERE rn = 1""",
    "ion_derived": f"""SELECT * FROM (SELECT d.spectrum_id, d.cut, d.ion, d.orientation, d.ion_charge, d.expected_u, p.mass_u, p.intensity,
        row_number() OVER (PARTITION BY d.spectrum_id, d.cut, d.ion ORDER BY p.intensity*(2*tol_u - abs(p.mass_u - at_u)) DESC, p.mass_u) AS rn
        FROM (SELECT e.*, e.expected_u + coalesce(b.mass_u - b.expected_u, 0) AS at_u, CASE WHEN b.mass_u IS NULL THEN {ION_TOL} ELSE {ION_TOL // 2} END AS tol_u
          FROM expected e LEFT JOIN ion_base b ON b.spectrum_id = e.spectrum_id AND b.cut = e.cut AND b.ion = e.parent WHERE e.parent IS NOT NULL) d
        JOIN peaks p ON p.spectrum_id = d.spectrum_id AND p.mass_u BETWEEN at_u - tol_u AND at_u + tol_u) WHERE rn = 1""",
    "ion_won": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY spectrum_id, mass_u, ion_charge, orientation ORDER BY abs(mass_u - expected_u), ion, cut) AS claim
        FROM (SELECT * FROM ion_base UNION ALL SELECT * FROM ion_derived)) WHERE claim = 1""",
    "ion_matches": """SELECT e.*, w.mass_u, w.intensity, w.mass_u - e.expected_u AS err_u, CASE WHEN w.mass_u IS NOT NULL THEN 'observed'
        WHEN e.expected_u BETWEEN lo_u AND hi_u THEN 'missing' ELSE 'not_visible' END AS status
        FROM expected e JOIN peak_range USING (spectrum_id) LEFT JOIN ion_won w ON w.spectrum_id = e.spectrum_id AND w.cut = e.cut AND w.ion = e.ion""",
    "single_edges": edges_sql(False),
    "fragments": f"""SELECT s.spectrum_id, pm_u, s.mass_u AS peak_u, s.intensity, r.ion, r.factor, CASE WHEN r.ion = 'b' THEN s.mass_u - {mass.PROTON} ELSE pm_u - s.mass_u END AS node_u
        FROM strong_set s JOIN spectra USING (spectrum_id) CROSS JOIN (VALUES ('b', 2), ('y', 1)) AS r(ion, factor)
        WHERE (CASE WHEN r.ion = 'b' THEN s.mass_u - {mass.PROTON} ELSE pm_u - s.mass_u END) BETWEEN 30000 AND pm_u - 550000""",
    "fragment_runs": f"""SELECT *, sum(start) OVER (PARTITION BY spectrum_id ORDER BY node_u) AS run FROM (SELECT *, CASE WHEN node_u - lag(node_u) OVER (PARTITION BY spectrum_id ORDER BY node_u) <= {EDGE_TOL}
        THEN 0 ELSE 1 END AS start FROM fragments)""",
    "merged_nodes": """SELECT spectrum_id, run, CAST(sum(intensity*factor*node_u)//sum(intensity*factor) AS BIGINT) AS mass_u, CAST(sum(intensity) - 25 AS BIGINT) AS score, count(*) AS n_frags
        FROM fragment_runs GROUP BY 1, 2""",
    "terminals": """SELECT spectrum_id, unnest([0, pm_u - 190184]) AS node_u, unnest(['n_term', 'c_term']) AS kind FROM spectra""",
    "graph_nodes": """SELECT spectrum_id, mass_u, score, n_frags FROM merged_nodes UNION ALL SELECT spectrum_id, CAST(node_u AS BIGINT) AS mass_u, CAST(0 AS BIGINT) AS score, CAST(0 AS BIGINT) AS n_frags FROM terminals""",
    "graph_edges": edges_sql(False, "graph_nodes", "score"),
    "hops": f"SELECT spectrum_id, from_u, to_u, label, to_score - (abs(err_u)*10//{EDGE_TOL}) AS gain FROM graph_edges",
    "strong_set": """SELECT p.spectrum_id, p.mass_u, p.intensity FROM peaks p JOIN peaks q ON q.spectrum_id = p.spectrum_id AND q.mass_u BETWEEN p.mass_u - 1000000 AND p.mass_u + 1000000
        GROUP BY ALL HAVING count(*) FILTER (WHERE q.intensity > p.intensity) + 1 <= 3
        AND count(*) FILTER (WHERE abs(p.mass_u - 10033 - q.mass_u) <= 2500) = 0""",
}


def with_views(sql: str) -> str:
    """Prefix a query with the views it names, in dependency order."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(view)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    prefix = ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        recursive = body[5:].lstrip().upper().startswith("RECURSIVE ")
        rest = body[5:].lstrip()[10:] if recursive else body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{prefix}, {rest}"
    return f"WITH {prefix} {body}"
