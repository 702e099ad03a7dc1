"""Byte-pair encoding and decoding with forced boundaries.

Two bytes that stand side by side in no token of the vocabulary can never be merged, so a text may
be cut between them. The plainest such place is in front of white space, where the splitting pattern
of these vocabularies also always parts; a text is cut there first and each fragment encodes on its
own. Fragments repeat, and are kept in a bounded cache. A fragment that is not in it is split by the
pattern, and every piece is cut at all its forced boundaries and encoded part by part.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F


#: White space of Unicode, as code points.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_WS = "".join(map(chr, _BLANKS))
#: Fixed value: the published splitting pattern of the byte-level vocabularies.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
CACHE_BYTES = 128 << 20
PAIRS = 400_000
_ENTRY = 200  # bytes that a cache entry takes besides its contents


@lru_cache(1)
def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in such vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Codec:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.inside = {tok[i : i + 2] for tok in self.ids for i in range(len(tok) - 1)}
        self.tokens: dict[int, bytes] = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.fragments = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
        self.pattern = regex.compile(_PATTERN)
        self.longest = max(map(len, self.ids))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.left = self.room = cache_bytes

    def merged(self, piece: bytes) -> list[int]:
        """Ids by the definition: the lowest-ranked pair is merged, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, none = self.ranks, len(self.ranks)
        scores = [ranks.get((parts[i], parts[i + 1]), none) for i in range(len(parts) - 1)]
        while scores and (low := min(scores)) < none:
            i = scores.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = ranks.get((parts[i - 1], parts[i]), none)
            if i < len(scores):
                scores[i] = ranks.get((parts[i], parts[i + 1]), none)
        return [self.ids[p] for p in parts]

    def _stand_together(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a``: do the bytes of both merge to just these two?"""
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok

    def _piece(self, piece: bytes) -> list[int]:
        """Ids of a piece: the one sequence of tokens in which all neighbours may stand together.

        Longest tokens are tried first. The encoding of a prefix is unique, so a place from which no
        token goes on is left for good.
        """
        ids, n, at, out, dead = self.ids, len(piece), 0, [], set()
        size = min(n, self.longest)
        while at < n:
            while size:
                token = ids.get(piece[at : at + size])
                if token is not None and at + size not in dead and (not out or self._stand_together(out[-1], token)):
                    break
                size -= 1
            if size:
                out.append(token)
                at += size
                size = min(n - at, self.longest)
            else:
                dead.add(at)
                size = len(self.tokens[out.pop()])
                at -= size
                size -= 1
        return out

    def forced_pieces(self, piece: bytes) -> list[bytes]:
        """The bytes cut wherever two neighbours are side by side in no token."""
        inside, cuts = self.inside, [0]
        cuts += [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inside]
        return [piece[a:b] for a, b in zip(cuts, [*cuts[1:], len(piece)])]

    def _fresh(self, fragment: str) -> bytes:
        ids: list[int] = []
        for m in self.pattern.finditer(fragment):
            for piece in self.forced_pieces(m.group().encode()):
                ids += self._piece(piece)
        out = array("I", ids).tobytes()
        cost = len(fragment) + len(out) + _ENTRY
        if 20 * cost < self.room:  # one fragment never takes a large share of the cache
            if cost > self.left:
                self.cache.clear()
                self.left = self.room
            self.cache[fragment] = out
            self.left -= cost
        return out

    def _plain(self, text: str) -> bytes:
        found = self.fragments.findall(text)
        get = self.cache.get
        return b"".join([get(f) or self._fresh(f) for f in found])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; added tokens are found first."""
        if self.parts is None or not self.parts.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m.group()]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, special tokens included; byte sequences that are not UTF-8 are replaced."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(1)
def _codec(path: str) -> Codec:
    return Codec(path)


def encoder(path: str, keep: list[str] | None, text_at: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow step: the columns before ``text_at`` and what ``keep`` names of the encoding."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in keep}
            for text in batch.column(text_at).to_pylist():
                ids = codec.encode(text)
                for k, out in rows.items():
                    if k == "n_tokens":
                        out.append(len(ids) // 4)
                    elif k == "ids":
                        out.append(np.frombuffer(ids, "<u4").astype(np.int32))
                    elif k == "ids_sha256":
                        out.append(hashlib.sha256(ids).hexdigest())
                    elif k == "decoded":
                        out.append(codec.decode(ids))
                    elif k == "decoded_sha256":
                        out.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            cols = list(batch.columns[:text_at]) + [pa.array(v, _TYPES[k]) for k, v in rows.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:text_at], *rows])

    return run


_TYPES = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"n_tokens": "bigint", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, keep: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and, of each whole text, the columns in ``keep``: n_tokens, ids, ids_sha256, decoded, decoded_sha256.

    ``path`` is the vocabulary file, at the same place on every machine. A null or empty text has no
    ids. Rows are independent: null or repeated ids pass through, and an empty table gives no rows.
    Other columns are not read. Nothing is shuffled.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(encoder(path, keep, 1), "doc_id bigint, " + ", ".join(f"{k} {_SQL[k]}" for k in keep))
