"""Peptide and sequence jobs."""

from __future__ import annotations

import collections
import functools
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.functions import mass, text


def cut_masses(peptides: DataFrame, cols: Sequence[str], peptide: str = "peptide") -> DataFrame:
    """One row per inner cut with the prefix mass and the whole residue mass."""
    table = mass.residue_map()
    masses = F.transform(F.split(F.col(peptide), ""), lambda r: table[r])
    prefix = F.aggregate(
        F.col("_m"),
        F.array().cast("array<bigint>"),
        lambda acc, m: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + m)),
    )
    return (
        peptides.select(*cols, masses.alias("_m"))
        .select(*cols, F.posexplode(prefix).alias("_i", "cut_u"), F.aggregate("_m", F.lit(0).cast("bigint"), lambda a, m: a + m).alias("total_u"))
        .filter(F.col("_i") + 1 < F.length(peptide))
        .select(*cols, (F.col("_i") + 1).cast("int").alias("cut"), "cut_u", "total_u")
    )


def expected_ions(cuts: DataFrame, ions: list[str] | None = None) -> DataFrame:
    """Theoretical m/z of each ion at each cut."""
    part = F.when(F.col("i.orientation") == "prefix", F.col("cut_u")).otherwise(F.col("total_u") - F.col("cut_u"))
    return cuts.withColumn("i", F.explode(mass.ion_structs(ions))).select(
        *cuts.columns,
        F.col("i.ion").alias("ion"),
        F.col("i.orientation").alias("orientation"),
        F.col("i.ion_charge").alias("ion_charge"),
        F.col("i.parent").alias("parent"),
        F.col("i.strong").alias("strong"),
        F.floor((part + F.col("i.offset_u")) / F.col("i.ion_charge")).cast("bigint").alias("expected_u"),
    )


# --- tokens, masses and modifications -----------------------------------------

TOKEN = r"[A-Z](?:[+-][0-9]+)?"


def tokenize_peptide(df: DataFrame, col: str = "peptide") -> DataFrame:
    """Residue tokens with position; a leading ``[mass]`` is the N-terminal gap.

    ``valid`` is false when anything else remains in the text.
    """
    body = F.regexp_replace(col, r"^\[[0-9]+\]", "")
    return df.select(
        "*",
        F.regexp_extract(col, r"^\[([0-9]+)\]", 1).alias("gap_text"),
        (F.regexp_replace(body, TOKEN, "") == "").alias("valid"),
        F.posexplode_outer(F.regexp_extract_all(body, F.lit(f"({TOKEN})"), 1)).alias("pos", "token"),
    )


def parse_modifications(spec: str) -> dict[str, tuple[str, int, bool]]:
    """``C+57:M+16`` -> symbol -> (residue, shift in Da, fixed). ``C=57`` style marks a fixed change."""
    out = {}
    for part in filter(None, spec.split(":")):
        fixed = "=" in part
        residue, shift = part[0], int(part[1:].replace("=", ""))
        out[residue + f"{shift:+d}"] = (residue, shift, fixed)
    return out


def token_mass(token: Column, spec: str) -> Column:
    """Mass of a residue token under a modification list; NULL when the token is not allowed.

    A fixed modification changes its base residue; an optional one adds a symbol.
    """
    masses = dict(mass.RESIDUE_MASS)
    mods = parse_modifications(spec)
    for residue, shift, fixed in mods.values():
        if fixed:
            masses[residue] += shift * mass.UNIT
    for symbol, (residue, shift, fixed) in mods.items():
        if not fixed:
            masses[symbol] = masses[residue] + shift * mass.UNIT
    return mass.residue_map(masses)[token]


def modified_masses(df: DataFrame, spec: str, col: str = "peptide") -> DataFrame:
    tokens = F.regexp_extract_all(F.regexp_replace(col, r"^\[[0-9]+\]", ""), F.lit(f"({TOKEN})"), 1)
    return df.withColumn(
        "mass_u", F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc + token_mass(t, spec))
    )


def strip_modifications(col: Column) -> Column:
    return F.regexp_replace(col, r"[+-][0-9]+", "")


def count_letters(seq: Column, chars: str) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(seq, f"[{chars}]", ""))


def proton_mobility(seq: Column, charge: Column) -> Column:
    """mobile when fewer basic residues than protons; fixed when arginines hold them all; else partial."""
    return (
        F.when(count_letters(seq, "RHK") < charge, "mobile")
        .when(count_letters(seq, "R") >= charge, "non_mobile")
        .otherwise("partial")
    )


def prefix_mass_array(seq: Column) -> Column:
    """Masses after each residue of a peptide-sized sequence."""
    table = mass.residue_map()
    return F.aggregate(
        F.split(seq, ""),
        F.array().cast("array<bigint>"),
        lambda acc, r: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + table[r])),
    )


def is_correct(path: Column, n_mass: Column, peptide: Column, tol: int = 6 * mass.UNIT) -> Column:
    """The path occurs in the peptide up to I/L and K/Q, and its start mass fits a cut."""
    same = lambda c: F.translate(c, "IK", "LQ")
    at = F.instr(same(peptide), same(path))
    near = text.let(prefix_mass_array(peptide), lambda ms: F.exists(ms, lambda m: F.abs(m - n_mass) < tol))
    return (at > 0) & (((n_mass == 0) & (at == 1)) | near)


def correct_residues(path: Column, n_mass: Column, peptide: Column, tol: int = mass.UNIT) -> Column:
    """Residues of the path found in the peptide at the same mass position, up to I/L."""
    same = lambda c: F.translate(c, "I", "L")

    def placed(seq: Column, start: Column) -> Column:
        ends = prefix_mass_array(seq)
        return F.transform(
            ends, lambda m, i: F.struct((m + start).alias("m"), F.substring(same(seq), i + 1, F.lit(1)).alias("r"))
        )

    def count(truth: Column) -> Column:
        hit = lambda x: F.exists(truth, lambda y: (y["r"] == x["r"]) & (F.abs(y["m"] - x["m"]) < tol))
        return F.size(F.filter(placed(path, n_mass), hit))

    return text.let(placed(peptide, F.lit(0)), count)


def _char(seq: Column, i: Column) -> Column:
    return F.substring(seq, i, F.lit(1))


def weighted_edit_distance(a: Column, b: Column) -> Column:
    """Edit distance with cheap swaps: I/L, K/Q and F/m cost nothing, N/D one half.

    ``m`` stands for oxidised methionine. The plain distance with N/D at full cost and the
    one with N/D free enclose the result; only where they differ is the weighted table
    filled, one row per letter of ``a``.
    """
    x, y = F.translate(a, "IKm", "LQF"), F.translate(b, "IKm", "LQF")
    full = F.levenshtein(x, y)
    free = F.levenshtein(F.translate(x, "D", "N"), F.translate(y, "D", "N"))
    return F.when(full == free, full.cast("double")).otherwise(_weighted_table(x, y))


def _weighted_table(x: Column, y: Column) -> Column:
    half = lambda p, q: ((p == "N") & (q == "D")) | ((p == "D") & (q == "N"))
    first = F.transform(F.sequence(F.lit(0), F.length(y)), lambda j: j.cast("double"))

    def next_row(row: Column, i: Column) -> Column:
        p = _char(x, i)

        def cell(acc: Column, j: Column) -> Column:
            q = _char(y, j)
            swap = F.when(p == q, 0.0).when(half(p, q), 0.5).otherwise(1.0)
            best = F.least(F.element_at(acc, -1) + 1.0, F.element_at(row, j + 1) + 1.0, F.element_at(row, j) + swap)
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(y)), F.array(F.element_at(row, 1) + 1.0), cell)

    return F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(x)), first, next_row), -1)


def _free_letters(seq: Column) -> Column:
    """Letters that cost nothing or half to swap become one: the plain distance is then never above the weighted one."""
    return F.translate(seq, "IKmD", "LQFN")


def _probes(parts: int, chosen: int, within: int) -> list[tuple[int, int, tuple[int, ...], tuple[int, ...]]]:
    """(combination, length difference, parts, their shifts) that ``within`` errors can leave unchanged.

    Errors before, between and after the chosen parts make up the shifts; where no letter of the indexed
    text lies in between, letters can only have been added.
    """
    out = []
    for number, combo in enumerate(itertools.combinations(range(parts), chosen)):
        for delta in range(-within, within + 1):
            for shifts in itertools.product(range(-within, within + 1), repeat=chosen):
                steps = [b - a for a, b in zip((0, *shifts), (*shifts, delta))]
                gaps = [b - a - 1 for a, b in zip((-1, *combo), (*combo, parts))]
                if sum(map(abs, steps)) <= within and all(gap or step >= 0 for gap, step in zip(gaps, steps)):
                    out.append((number, delta, combo, shifts))
    return out


def _segment_keys(text: Column, parts: int, chosen: int, within: int, indexed: bool) -> Column:
    """Array of keys: indexed texts give one for each combination of parts, probing texts one for each shift, too."""
    found = _probes(parts, chosen, within)
    if indexed:
        found = [f for f in found if f[1] == 0 and not any(f[3])]
    places = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d"), F.array(*[F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")) for p, s in zip(c, o)]).alias("at")) for n, d, c, o in found])

    def key(place: Column) -> Column:
        length = F.length(text) - place["d"]
        begin = lambda x: F.floor(x["p"] * length / parts).cast("int")
        end = lambda x: F.floor((x["p"] + 1) * length / parts).cast("int")
        inside = F.forall(place["at"], lambda x: (begin(x) + x["s"] >= 0) & (end(x) + x["s"] <= F.length(text)))
        pieces = F.transform(place["at"], lambda x: F.substring(text, begin(x) + x["s"] + 1, end(x) - begin(x)))
        return F.when(inside & (length > 0), F.concat_ws("|", length.cast("string"), place["n"].cast("string"), pieces))

    return F.array_distinct(F.filter(F.transform(places, key), lambda k: k.isNotNull()))


def edit_distance_pairs(queries: DataFrame, database: DataFrame, within: float = 2.0, spare: int = 1, index: str = "target") -> DataFrame:
    """All (query, target, distance) of different texts whose weighted distance is at most ``within``.

    A text is cut into ``within`` + 1 + ``spare`` parts. So many errors leave ``spare`` + 1 of them unchanged,
    shifted by no more than the errors before them; pairs meet by equality on these parts, their number and
    the length, so no pair is lost and none meets on a single short part. More ``spare`` parts make keys
    longer and more of them. The ``index`` side (query or target), better the larger, has few keys a text.
    The plain distance with a bound sheds pairs before the weighted one is computed, once a pair.
    ``queries``: query; ``database``: target. Repeated texts count once; null and empty texts have no pairs.
    """
    errors = math.floor(within)
    parts, chosen = errors + 1 + spare, spare + 1

    def keyed(df: DataFrame, name: str) -> DataFrame:
        texts = df.select(name).filter(F.length(name) > 0).distinct().withColumn(f"{name}_free", _free_letters(F.col(name)))
        return texts.withColumn("key", F.explode(_segment_keys(F.col(f"{name}_free"), parts, chosen, errors, name == index)))

    met = keyed(queries, "query").join(keyed(database, "target"), "key")
    close = met.filter(F.levenshtein("query_free", "target_free", errors) >= 0).select("query", "target").distinct()
    return close.withColumn("distance", weighted_edit_distance(F.col("query"), F.col("target"))).filter(F.col("distance") <= within)


# Residue groups by side chain; a composition category is the group text of a short run.
RESIDUE_GROUPS = ("AVLIMC", "FWY", "STNQ", "KRH", "DE", "GP")


def residue_group(seq: Column) -> Column:
    out = seq
    src = "".join(RESIDUE_GROUPS)
    dst = "".join(str(i) * len(g) for i, g in enumerate(RESIDUE_GROUPS))
    return F.translate(out, src, dst)


def composition_categories(df: DataFrame, col: str = "peptide", max_len: int = 3) -> DataFrame:
    """Counts of 1..max_len runs by residue group at the start, in the middle and at the end."""
    groups = residue_group(F.col(col))
    n = F.length(col)
    rows = []
    for k in range(1, max_len + 1):
        runs = F.regexp_extract_all(groups, F.lit(f"(?=(.{{{k}}}))"), 1)
        rows.append(_placed_runs(runs, n, k))
    return (
        df.filter(n >= max_len)
        .select(F.inline(F.concat(*rows)))
        .groupBy("place", "n_res", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _placed_runs(runs: Column, n: Column, k: int) -> Column:
    def row(run: Column, i: Column) -> Column:
        place = F.when(i == 0, "start").when(i == n - k, "end").otherwise("middle")
        return F.struct(place.alias("place"), F.lit(k).alias("n_res"), run.alias("category"))

    return F.transform(runs, row)


def match_score(query: Column, peptide: Column) -> Column:
    """Best ungapped overlap: +1 equal (I = L), Z against Q/K +0.5, else -0.5; X is free when
    the query leads."""

    def pair(m: Column, p: Column, lead: bool) -> Column:
        il = m.isin("I", "L") & p.isin("I", "L")
        expr = F.when((m == p) | il, 1.0).when((m == "Z") & p.isin("Q", "K"), 0.5)
        if lead:
            expr = F.when(m == p, 1.0).when(m == "X", 0.0).when(il, 1.0).when((m == "Z") & p.isin("Q", "K"), 0.5)
        return expr.otherwise(-0.5)

    def offset(outer: Column, inner: Column, lead: bool) -> Column:
        def total(i: Column) -> Column:
            steps = F.least(F.length(outer) - i, F.length(inner))
            return F.aggregate(
                F.sequence(F.lit(1), steps),
                F.lit(0.0),
                lambda acc, j: acc
                + (
                    pair(_char(outer, i + j), _char(inner, j), True)
                    if lead
                    else pair(_char(inner, j), _char(outer, i + j), False)
                ),
            )

        return F.array_max(F.transform(F.sequence(F.lit(0), F.length(outer) - 1), total))

    return F.greatest(offset(query, peptide, True), offset(peptide, query, False))


# --- k-mers and database lookups ------------------------------------------------


def kmer_array(seq: Column, k: int) -> Column:
    """All windows of k letters in one pass over the text."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), 1)


def kmers(proteins: DataFrame, k: int) -> DataFrame:
    return proteins.select("protein_id", F.posexplode(kmer_array(F.col("seq"), k)).alias("pos", "kmer"))


def tag_lookup(tags: DataFrame, proteins: DataFrame, lengths: Sequence[int] = (3, 4, 5, 6)) -> DataFrame:
    """Positions of distinct tags in the proteins, in one pass over them.

    Each position gives its next letters once. A table of the tags' first letters, bounded by the alphabet,
    tells which tag lengths can begin there; only these go on to the equality join. A tag of another
    length is an error.
    """
    lengths = sorted(lengths)
    least, most = lengths[0], lengths[-1]
    known = F.length("tag").isin(lengths)
    message = F.concat(F.lit("no index for tags of this length: "), F.col("tag"))
    wanted = tags.select(F.when(known, F.col("tag")).otherwise(F.raise_error(message)).alias("tag")).distinct()
    head = lambda c: F.substring(c, 1, least)
    heads = F.broadcast(wanted.groupBy(head("tag").alias("head")).agg(F.collect_set(F.length("tag")).alias("lengths")))
    windows = F.regexp_extract_all("seq", F.lit(f"(?=(.{{{least},{most}}}))"), 1)
    places = proteins.select("protein_id", F.posexplode(windows).alias("pos", "window")).withColumn("head", head("window"))
    begun = places.join(heads, "head").select("protein_id", "pos", "window", F.explode("lengths").alias("k")).filter(F.col("k") <= F.length("window"))
    return begun.select("protein_id", "pos", F.substring("window", F.lit(1), F.col("k")).alias("tag")).join(wanted, "tag").select("protein_id", "pos", "tag")


def candidates_with_mass(proteins: DataFrame, target: int, tol: int) -> DataFrame:
    """Protein substrings whose residues weigh ``target`` +- ``tol``; one test per start.

    Masses add up along the texts of a batch, so for each start one search finds the first end that is not too
    light; a letter without a mass, like the end of a text, is too heavy for any. Only what fits is cut out of its text.
    """
    heavy = 10**12
    weight = np.full(128, heavy, np.int64)
    for residue, own in mass.RESIDUE_MASS.items():
        weight[ord(residue)] = own

    def hits(names: pa.Array, texts: list[str]) -> pa.RecordBatch:
        code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        upto = np.concatenate([[0], np.cumsum(np.where(code < 128, weight[np.minimum(code, 127)], heavy))])
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        end = np.searchsorted(upto, upto[:-1] + target - tol, "left")
        # no sum but that of no letters is a match at once
        end = np.minimum(np.maximum(end, np.arange(len(code)) + 1), len(code))
        found = upto[end] - upto[:-1]
        start = np.flatnonzero((found >= target - tol) & (found <= target + tol))
        row = np.searchsorted(begin, start, "right") - 1
        places = zip(row.tolist(), (start - begin[row]).tolist(), (end[start] - begin[row]).tolist())
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(row)), pa.array((start - begin[row]).astype(np.int32)), pa.array([texts[r][i:j] for r, i, j in places], pa.string()), pa.array(found[start])],
            names=["protein_id", "start", "peptide", "mass_u"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy()
            turn = (np.cumsum(size) - size) // LETTERS_AT_ONCE
            for own in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(turn)) + 1):
                if len(own):
                    part = batch.slice(own[0], len(own))
                    yield hits(part.column(0), [t or "" for t in part.column(1).to_pylist()])

    kind = proteins.schema["protein_id"].dataType.simpleString()
    return proteins.select("protein_id", "seq").mapInArrow(run, f"protein_id {kind}, start int, peptide string, mass_u bigint")


_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [t for turns in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in turns * 4]
#: Letters whose digests are found together.
DIGESTS_AT_ONCE = 1 << 14
#: Letters of the texts that are shuffled together, and of one text at least.
LETTERS_AT_ONCE = 1 << 19


def _md5_mix(i: int, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, int]:
    if i < 16:
        return d ^ (b & (c ^ d)), i
    if i < 32:
        return c ^ (d & (b ^ c)), (5 * i + 1) % 16
    return (b ^ c ^ d, (3 * i + 5) % 16) if i < 48 else (c ^ (b | ~d), 7 * i % 16)


def _md5(blocks: np.ndarray) -> np.ndarray:
    """The md5 digests of padded messages of one block each, as two big-endian numbers; all messages go through each step together."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    filled = words.any(axis=1)
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(blocks), x) for x in start)
    for i in range(64):
        mix, at = _md5_mix(i, b, c, d)
        mix += a
        mix += np.uint32(_MD5_ADD[i])
        if filled[at]:
            mix += words[at]
        turn = np.uint32(_MD5_TURN[i])
        a, d, c, b = d, c, b, b + ((mix << turn) | (mix >> (np.uint32(32) - turn)))
    out = np.stack([x + s for x, s in zip((a, b, c, d), start)], axis=1).astype("<u4")
    return out.view(">u8").astype(np.uint64)


def _place_digests(heads: list[bytes], sizes: list[int]) -> np.ndarray:
    """Digests of ``head`` and place, for the places 0 .. size - 1 of each text, one text after the other."""
    out, held, room = [], [], DIGESTS_AT_ONCE
    for head, size in zip(heads, sizes):
        at = 0
        while at < size:
            # places of one number of digits
            to = min(size, at + room, 10 ** len(str(at)))
            held.append((head, at, to))
            room -= to - at
            at = to
            if not room:
                out.append(_md5(_blocks(held)))
                held, room = [], DIGESTS_AT_ONCE
    return np.concatenate([*out, _md5(_blocks(held))])


def _blocks(pieces: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The messages ``head`` and place, padded to a block."""
    blocks, row = np.zeros((sum(to - at for _, at, to in pieces), 64), np.uint8), 0
    for head, at, to in pieces:
        own, n, digits = blocks[row : row + to - at], len(head), len(str(at))
        own[:, :n] = np.frombuffer(head, np.uint8)
        place = np.arange(at, to)
        for k in range(digits):
            own[:, n + k] = place // 10 ** (digits - 1 - k) % 10 + 48
        own[:, n + digits] = 0x80
        own[:, 56:58] = np.frombuffer((8 * (n + digits)).to_bytes(2, "little"), np.uint8)
        row += to - at
    return blocks


def _shuffled(seed: int, keys: list[int | None], seqs: list[str]) -> list[str]:
    """The letters of each text in the order of the digests md5(seed:key:place), equal ones by letter."""
    heads = ["".join(f"{x}:" for x in (seed, key) if x is not None).encode() for key in keys]
    digests, out, at = _place_digests(heads, list(map(len, seqs))), [], 0
    for seq in seqs:
        high, low = digests[at : at + len(seq)].T
        at += len(seq)
        letters = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
        order = np.argsort(high)
        if (high[order[1:]] == high[order[:-1]]).any():
            order = np.lexsort((letters, low, high))
        out.append(letters[order].tobytes().decode("utf-32-le"))
    return out


def decoy_shuffle(proteins: DataFrame, seed: int) -> DataFrame:
    """Each protein and its shuffled decoy ``XXX_<id>``; the permutation orders letters by a seeded hash.

    Both come from one pass over the proteins. The digests of many letters are found together in numpy, and sorted as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            ids, _, seqs = (batch.column(c).to_pylist() for c in range(3))
            names = [None if i is None else f"XXX_{i}" for i in ids]
            texts, shuffled, ends = [s or "" for s in seqs], [], np.cumsum([len(s or "") for s in seqs])
            while (a := len(shuffled)) < len(texts):
                # whole texts, as many as keep their digests small
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + LETTERS_AT_ONCE, "right")))
                shuffled += _shuffled(seed, ids[a:b], texts[a:b])
            decoys = pa.array([None if s is None else d for s, d in zip(seqs, shuffled)], batch.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, batch.schema.field(1).type), decoys], schema=batch.schema)

    given = proteins.select("protein_id", "name", "seq")
    return given.mapInArrow(run, f"protein_id {given.schema['protein_id'].dataType.simpleString()}, name string, seq string")


def runs_of(seqs: DataFrame, col: str, lo: int, hi: int, name: str) -> DataFrame:
    """All distinct substrings of ``lo``..``hi`` letters of a short sequence."""
    arrays = [F.regexp_extract_all(col, F.lit(f"(?=(.{{{k}}}))"), 1) for k in range(lo, hi + 1)]
    return seqs.withColumn(name, F.explode(F.array_distinct(F.flatten(F.array(*arrays)))))


def contained_tags(tags: DataFrame, ranked: DataFrame, lo: int = 3, hi: int = 6) -> DataFrame:
    """Per set and tag: best rank of a path that holds the tag, and the share of the top 5,
    top 20 and all paths that do. ``ranked``: set_id, seq, rank."""
    totals = ranked.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    held = runs_of(ranked, "seq", lo, hi, "tag").join(tags.select("tag").distinct(), "tag")
    agg = held.groupBy("set_id", "tag").agg(
        F.min("rank").alias("first_rank"),
        F.count_if(F.col("rank") <= 5).alias("n5"),
        F.count_if(F.col("rank") <= 20).alias("n20"),
        F.count(F.lit(1)).alias("n_all"),
    )
    return agg.join(totals, "set_id").select(
        "set_id",
        "tag",
        "first_rank",
        (F.col("n5") / F.least(F.col("n"), F.lit(5))).alias("share5"),
        (F.col("n20") / F.least(F.col("n"), F.lit(20))).alias("share20"),
        (F.col("n_all") / F.col("n")).alias("share_all"),
    )


def drop_covered(tags: DataFrame, key: str) -> DataFrame:
    """Drop a tag that contains a shorter tag of its set, whatever the lengths.

    A dropped shorter tag itself contains an accepted one, so the test needs no order. Different tags are
    laid out into their substrings once for all sets, of those lengths that any tag has; of these only the ones
    that are tags themselves go to the sets of the longer one.
    """
    distinct = tags.select(key, "tag").distinct()
    words = distinct.select("tag").distinct()
    lengths = F.broadcast(words.agg(F.collect_set(F.length("tag")).alias("lengths")))  # one row, one number per length
    parts = F.flatten(
        F.transform(
            F.filter("lengths", lambda k: k < F.length("longer")),
            lambda k: F.transform(F.sequence(F.lit(1), F.length("longer") - k + 1), lambda i: F.substring("longer", i, k)),
        )
    )
    inner = words.withColumnRenamed("tag", "longer").crossJoin(lengths).select("longer", F.explode(F.array_distinct(parts)).alias("tag"))
    inside = inner.join(words, "tag", "left_semi")
    held = distinct.withColumnRenamed("tag", "longer").join(inside, "longer").select(key, "longer", "tag")
    covered = held.join(distinct, [key, "tag"], "left_semi").select(key, F.col("longer").alias("tag")).distinct()
    return distinct.join(covered, [key, "tag"], "left_anti")


# --- query sequence scores --------------------------------------------------------

# Probabilities that a residue call is right, used in the expected score.
SINGLE_RISK = {"R": 0.80, "N": 0.96, "Q": 0.96, "W": 0.70}
DOUBLE_RISK = {"GV": 0.85, "VS": 0.95, "SV": 0.95, "DA": 0.90, "AD": 0.95, "AG": 0.96}
OXIDISED_FOR_F = 0.9
K_FIRST, K_MIDDLE, K_LAST = 0.45, 0.25, 1.0
MIN_RESIDUE_PROB = 0.275


def expected_query_score(seq: Column, probs: Column, min_len: int = 7) -> Column:
    """Expected match score of a query sequence from its residue probabilities.

    ``m`` is oxidised methionine, ``X`` any residue, ``Z`` Q or K, ``B`` the boundary. The
    plain sum is discounted at ambiguous residues; then the worst risky position counts.
    """
    n = F.length(seq)
    chars = F.split(seq, "")
    scale = 1.0 / (1.0 - MIN_RESIDUE_PROB)
    half = lambda c, v: F.when(c == "X", 0.0).when(c == "Z", v * 0.5).otherwise(v)
    mods = F.zip_with(chars, probs, lambda c, p: half(c, (p - MIN_RESIDUE_PROB) * scale))
    head = half(F.element_at(chars, 1), F.element_at(probs, 1))
    add = lambda a, x: a + x
    zero = F.lit(0.0)
    prefix = lambda i: F.when(i > 0, head + F.aggregate(F.slice(mods, F.lit(2), F.greatest(i - 1, F.lit(0))), zero, add)).otherwise(0.0)
    suffix = lambda i: F.aggregate(F.slice(mods, i, F.greatest(n - i + 1, F.lit(0))), zero, add)
    boundary = F.element_at(chars, 1) == "B"

    def discount(c: Column, p: Column, i: Column) -> Column:
        """0-based position i."""
        loss = p + 1
        k_first = boundary & (i == 1)
        middle = (i >= F.when(boundary, 2).otherwise(0)) & (i < n - 1)
        last = i == n - 1
        lys = F.when(c == "K", F.when(k_first, (1 - K_FIRST) * loss).otherwise(0.0) + F.when(middle, (1 - K_MIDDLE) * loss).otherwise(0.0) + F.when(last, (1 - K_LAST) * loss).otherwise(0.0)).otherwise(0.0)
        gln = F.when(c == "Q", F.when(k_first, K_FIRST * loss).otherwise(0.0) + F.when(middle, K_MIDDLE * loss).otherwise(0.0) + F.when(last, K_LAST * loss).otherwise(0.0)).otherwise(0.0)
        ox = F.when(c == "m", OXIDISED_FOR_F * loss).when(c == "F", (1 - OXIDISED_FOR_F) * loss).otherwise(0.0)
        return lys + gln + ox

    places = F.transform(F.arrays_zip(chars.alias("c"), probs.alias("p")), lambda x, i: discount(x["c"], x["p"], i))
    simple = prefix(n) - F.aggregate(places, zero, add)
    single = F.create_map(*[F.lit(v) for kv in SINGLE_RISK.items() for v in kv])
    double = F.create_map(*[F.lit(v) for kv in DOUBLE_RISK.items() for v in kv])

    def risky(i: Column, p: Column) -> Column:
        before, after = prefix(i) - n + i, suffix(i + 2) - i - 1
        return p * simple + (1 - p) * F.greatest(before, after)

    at1 = F.transform(F.sequence(F.lit(1), n - 2), lambda i: risky(i, single[_char(seq, i + 1)]))
    at2 = F.transform(F.sequence(F.lit(1), n - 3), lambda i: risky(i, double[F.substring(seq, i + 1, F.lit(2))]))
    worst = F.array_min(F.filter(F.concat(F.array(simple), at1, at2), lambda v: v.isNotNull()))
    return F.when(n < min_len, F.lit(float("-inf"))).otherwise(worst)


def gap_variants(df: DataFrame, seq: str, n_gap: str, max_run: int = 7, tol: int = 5_000) -> DataFrame:
    """Boundary forms of a sequence: ``B`` plus every run of X whose residues can fill the gap."""
    lo, hi = min(mass.RESIDUE_MASS.values()), max(mass.RESIDUE_MASS.values())
    runs = F.filter(
        F.sequence(F.lit(1), F.lit(max_run)), lambda g: (g * lo - tol <= F.col(n_gap)) & (F.col(n_gap) <= g * hi + tol)
    )
    forms = F.when(F.col(n_gap) < mass.UNIT, F.array(F.lit(0))).otherwise(runs)
    return df.withColumn("n_x", F.explode_outer(forms)).withColumn(
        "variant",
        F.when(F.col("n_x").isNull(), F.col(seq)).otherwise(
            F.concat(F.lit("B"), F.repeat(F.lit("X"), F.col("n_x")), F.col(seq))
        ),
    )


# Limits of gap runs: letters of a run, half-Dalton bins that have a table row, and shares below which a run length is left out.
MOST_GAP, GAP_BINS = 7, 1180
GAP_SHARE, WEAK_GAP_SHARE = 0.075, 0.05
#: A residue call is weak up to this probability; a weak run is replaced when all of it is right with at most RUN_PROB.
WEAK_PROB, LEAST_PROB, RUN_PROB, RUN_MASS = 0.67, 0.03, 0.45, 400 * mass.UNIT


def half_dalton(gap: Column) -> Column:
    return F.floor((gap * 2 + mass.UNIT // 2) / mass.UNIT).cast("int")


@functools.lru_cache(maxsize=1)
def gap_shares() -> list[tuple[int, int, float]]:
    """(half-Dalton bin, run length, share): how likely a gap of this mass is a run of so many residues.

    The number of residue strings of each length and mass is built up letter by letter; a length counts by
    the part of its strings that fall into the bin or one beside it, and shares add up to 1 a bin.
    """
    letters, sums = list(mass.RESIDUE_MASS.values()), {0: 1}
    most = (GAP_BINS + 1) * mass.UNIT // 2
    weight: dict[tuple[int, int], int] = collections.Counter()
    for g in range(1, MOST_GAP + 1):
        grown: dict[int, int] = collections.Counter()
        for m, n in sums.items():
            for r in letters:
                if m + r <= most:
                    grown[m + r] += n
        sums = grown
        for m, n in sums.items():
            for near in (-1, 0, 1):
                weight[(2 * m + mass.UNIT // 2) // mass.UNIT + near, g] += n * len(letters) ** (MOST_GAP - g)
    total: dict[int, int] = collections.Counter()
    for (at, _), w in weight.items():
        total[at] += w
    return [(at, g, w / total[at]) for (at, g), w in sorted(weight.items()) if at < GAP_BINS]


def gap_runs(spark: SparkSession, least: float) -> DataFrame:
    """(gap_bin, n_x) of the run lengths with a share above ``least``; at most GAP_BINS * MOST_GAP rows."""
    return F.broadcast(spark.createDataFrame([(at, g) for at, g, share in gap_shares() if share > least], "gap_bin int, n_x int"))


def boundary_variants(df: DataFrame, seq: str, n_gap: str, c_gap: str, digest: Sequence[str] = ("K", "R")) -> DataFrame:
    """Add ``variant``, ``n_x`` and ``c_x``: forms of a sequence with its gaps on both sides filled.

    Without a gap before it a sequence begins with the boundary ``B``; a gap becomes ``B`` and every run of
    X that may fill it. Each of these forms also ends, where the gap behind it holds a digest residue and at
    least one more, with every run of X for the rest and that residue. A gap that no run fills, or that is
    beyond the table, leaves its side as it is.
    """
    runs = gap_runs(df.sparkSession, GAP_SHARE)
    first = F.col(n_gap) < mass.UNIT
    begun = df.withColumn("gap_bin", F.when(~first, half_dalton(F.col(n_gap)))).join(runs, "gap_bin", "left").drop("gap_bin")
    lead = F.when(first & ~F.col(seq).startswith("B"), F.concat(F.lit("B"), seq)).when(F.col("n_x").isNotNull(), F.concat(F.lit("B"), F.repeat(F.lit("X"), F.col("n_x")), F.col(seq)))
    begun = begun.withColumn("variant", F.coalesce(lead, F.col(seq)))
    smallest = 56 * mass.UNIT
    ends = F.array(*[F.struct(F.lit(r).alias("last"), F.lit(mass.RESIDUE_MASS[r]).cast("bigint").alias("last_u")) for r in digest])
    open_end = begun.select("*", F.inline(ends)).filter(F.col(c_gap) >= F.col("last_u") + smallest)
    ended = open_end.withColumn("gap_bin", half_dalton(F.col(c_gap) - F.col("last_u"))).join(runs.withColumnRenamed("n_x", "c_x"), "gap_bin")
    ended = ended.withColumn("variant", F.concat("variant", F.repeat(F.lit("X"), F.col("c_x")), "last"))
    columns = [*df.columns, "n_x", "c_x", "variant"]
    return begun.withColumn("c_x", F.lit(None).cast("int")).select(*columns).unionByName(ended.select(*columns))


def weak_run_variants(df: DataFrame, seq: str, probs: str) -> DataFrame:
    """Add ``start``, ``n_weak``, ``n_x`` and ``variant``: a run of weak residue calls replaced by runs of X of its mass.

    From each weak position the run goes on while calls stay weak and its mass small. It is replaced when it
    has two letters or more, is unlikely to be right as a whole and is neither the beginning nor the end;
    of the forms those stay that keep more than four letters and no more X than letters.
    """
    n = F.length(seq)
    table, letters = mass.residue_map(), F.split(F.col(seq), "")
    spots = df.filter(n >= 5).select("*", F.explode(F.sequence(F.lit(1), n - 3)).alias("start"))
    calls = F.slice(F.arrays_zip(letters.alias("c"), F.col(probs).alias("p")), F.col("start") + 1, F.lit(10_000))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("m"), F.lit(1.0).alias("p"), F.lit(True).alias("open"))

    def step(s: Column, x: Column) -> Column:
        heavier = s["m"] + table[x["c"]]
        goes = s["open"] & (x["p"] <= WEAK_PROB) & F.coalesce(heavier <= RUN_MASS, F.lit(False))
        longer = F.struct((s["n"] + 1).alias("n"), heavier.alias("m"), (s["p"] * F.greatest(x["p"], F.lit(LEAST_PROB))).alias("p"), F.lit(True).alias("open"))
        return F.when(goes, longer).otherwise(F.struct(s["n"].alias("n"), s["m"].alias("m"), s["p"].alias("p"), F.lit(False).alias("open")))

    weak = spots.withColumn("run", F.aggregate(calls, start, step))
    weak = weak.filter((F.col("run.n") >= 2) & (F.col("run.p") <= RUN_PROB) & (F.col("start") + F.col("run.n") < n)).withColumn("gap_bin", half_dalton(F.col("run.m")))
    found = weak.join(gap_runs(df.sparkSession, WEAK_GAP_SHARE), "gap_bin").withColumn("n_weak", F.col("run.n"))
    variant = F.concat(F.substring(seq, F.lit(1), F.col("start")), F.repeat(F.lit("X"), F.col("n_x")), F.substring(F.col(seq), F.col("start") + F.col("n_weak") + 1, n))
    xs = F.length("variant") - F.length(F.replace("variant", F.lit("X")))
    kept = (F.length("variant") - xs > 4) & (xs * 2 <= F.length("variant")) & (xs <= MOST_GAP) & ~F.col("variant").startswith("X") & ~F.col("variant").endswith("X")
    return found.withColumn("variant", variant).filter(kept).select(*df.columns, "start", "n_weak", "n_x", "variant")
