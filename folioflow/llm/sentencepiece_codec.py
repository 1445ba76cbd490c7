"""Operator 8, SentencePiece encoding and decoding: streaming Viterbi.

A text is read from piece start to piece start: edges of the lattice go forward along a tree of pieces, and each
position keeps its best last piece and the position before it. Only a window of about the longest piece's length is
open: once the backpointers of all open positions lead through one boundary, the pieces before it are committed and
forgotten.

Scores depend on the model. A unigram model adds its pieces' log probabilities. The public model of this box is a BPE
model, whose segmentation is not the best sum of any scores; there an edge is allowed only where last piece and new
piece stand together in BPE's own output (their joined text encodes to the two), which leaves one valid path to every
position. So the same lattice, window and commit rule give the library's ids for both kinds.

Where no piece holds a space but at its start, every path goes through the boundary before a space; the stream is then
run word by word, and the ids of words of late are remembered.

White space other than spaces is plain text; a space becomes U+2581, and one is put before the text. Decoding takes
it away. Characters without a piece become bytes. Models with user-defined pieces, or with normalisation, are rejected.

Defined cases: NULL and '' have no ids and decode to ''. Each input row gives one row, repeated ones too. Only id and
text are read. Texts of any length: open state is bounded by the longest piece. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import documents, in_arrow, steps

TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO = 400_000
PAIRS = 400_000
UNIGRAM, BPE = 1, 2
NOTHING = (None, {})
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Memo(dict):
    """Ids of words, as bytes. Two generations: words of the older one that are met again go to the younger."""

    def __init__(self, make, longest: int):
        self.make, self.longest, self.older = make, longest, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = np.array(self.make(word), "<i4").tobytes()
        if len(word) <= self.longest:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Codec:
    """Encoder and decoder of a .model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        kinds = pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have a lattice")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models without normalisation, with a space before the text, are supported")
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces aren't supported")
        self.bpe = proto.trainer_spec.model_type == BPE
        self.names = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.control = {i for i, p in enumerate(proto.pieces) if p.type in (kinds.CONTROL, kinds.UNKNOWN)}
        self.longest = max(map(len, self.id))
        self.raw = [b"" if i in self.control else bytes([self.value[i]]) if i in self.value else name.replace(SPACE, " ").encode() for i, name in enumerate(self.names)]
        self.least = min(self.score.values(), default=0.0) - 10.0
        # a piece may hold a space only at its start, or consist of spaces: then words can be split off in front of one
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.pairs: dict[int, bool] = {}
        self.words = Memo(self.ids, 2 * self.longest)

    @cached_property
    def tree(self) -> dict:
        """Pieces by their characters: each leads to (the id of the piece that ends here or None, what may follow)."""
        out: dict = {}
        for piece, i in self.id.items():
            node = out
            for c in piece[:-1]:
                node = node.setdefault(c, [None, {}])[1]
            node.setdefault(piece[-1], [None, {}])[0] = i
        return out

    @cached_property
    def none(self) -> int:
        """An id that no piece has: for the text's start and for a character without a piece, which parts what is
        around it."""
        return max(self.id.values()) + 1

    @cached_property
    def scores(self) -> list[float]:
        """By id; a character without a piece comes last."""
        out = [self.least] * (self.none + 1)
        for piece, i in self.id.items():
            out[i] = self.score[piece]
        return out

    # -- BPE compatibility of two neighbours

    def merged(self, text: str, cut: int = 0) -> list[str] | None:
        """BPE of a short text: the pair of the best score merges first, the leftmost of equals. None as soon as a
        merge crosses the place `cut`, if one is given."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if at == cut - 1:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at < cut:
                cut -= 1
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE parts the joined text of two pieces, by their ids, into these two."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = "" if left == self.none else self.names[left], self.names[right]
        ok = self.pairs[left * self.none + right] = self.merged(a + b, len(a)) == ([a, b] if a else [b])
        return ok

    # -- the lattice

    def stream(self, text: str):
        """Yields lists of pieces as they are committed."""
        for part in self.walk(text):
            yield [text[a:b] for a, b, _ in part]

    def walk(self, text: str):
        """Yields lists of (begin, end, id) of pieces as they are committed; the id is `none` for a character without
        a piece. text has its spaces replaced already. Positions count from the last boundary, so state is as long as
        the window."""
        n, none, longest, bpe = len(text), self.none, self.longest, self.bpe
        edges = self.bpe_edges if bpe else self.unigram_edges
        window = min(n, 2 * longest)
        length = min(window + longest, n) + 1
        last: list[int | None] = [none] + [None] * length  # id of the best last piece of each open position
        back = [0] * (length + 1)  # where it begins
        best = [0.0] * (0 if bpe else length + 1)  # its path's score
        done = start = 0  # the boundary in the text; the position to go on from
        while done < n:
            stop = max(start, min(window, n - done))
            edges(text, done, start, stop, last, back, best)
            start = stop
            cut = stop if done + stop >= n else self.boundary(last, back, start)
            if not cut:  # all paths are still apart: the window grows
                window += longest
                last += [None] * longest
                back += [0] * longest
                best += [0.0] * (0 if bpe else longest)
                continue
            out, at = [], cut
            while at:
                out.append((done + back[at], done + at, last[at]))
                at = back[at]
            out.reverse()
            yield out
            if done + cut == n:
                return
            done, start, window = done + cut, start - cut, 2 * longest
            last, back = last[cut:] + [None] * cut, [x - cut for x in back[cut:]] + [0] * cut
            if not bpe:
                best = [x - best[cut] for x in best[cut:]] + [0.0] * cut

    def bpe_edges(self, text: str, done: int, start: int, stop: int, last: list, back: list, best: list) -> None:
        """Edges from the positions start to stop; the first that fits is the only one to a position."""
        none, root, known, longest = self.none, self.tree, self.pairs.get, self.longest
        for start in range(start, stop):
            left = last[start]
            if left is None:
                continue
            kids, key, k = root, left * none, start
            for c in text[done + start : done + start + longest]:
                node = kids.get(c)
                if node is None:
                    break
                k += 1
                i, kids = node
                if i is not None and last[k] is None:
                    ok = known(key + i)
                    if ok or ok is None and self.fits(left, i):
                        last[k], back[k] = i, start
            if last[start + 1] is None and root.get(text[done + start], NOTHING)[0] is None:
                last[start + 1], back[start + 1] = none, start

    def unigram_edges(self, text: str, done: int, start: int, stop: int, last: list, back: list, best: list) -> None:
        """Edges from the positions start to stop; the best sum of scores stays."""
        root, scores, none = self.tree, self.scores, self.none
        for start in range(start, stop):
            if last[start] is None:
                continue
            kids, k = root, start
            for c in text[done + start : done + start + self.longest]:
                node = kids.get(c)
                if node is None:
                    break
                k += 1
                i, kids = node
                if i is not None and (last[k] is None or best[start] + scores[i] > best[k]):
                    last[k], back[k], best[k] = i, start, best[start] + scores[i]
            k = start + 1
            if root.get(text[done + start], NOTHING)[0] is None and (last[k] is None or best[start] + scores[none] > best[k]):
                last[k], back[k], best[k] = none, start, best[start] + scores[none]

    @staticmethod
    def boundary(last: list[int | None], back: list[int], start: int) -> int:
        """The rightmost boundary that the paths of all open positions share: those reached from `start` on."""
        heads = {k for k in range(start, len(last)) if last[k] is not None}
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(back[top])
        return heads.pop()

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        none = self.none
        for part in self.walk(text):
            for a, b, i in part:
                if i != none:
                    out.append(i)
                elif self.byte:
                    out += [self.byte[x] for x in text[a:b].encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
        return out

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as 32-bit numbers, little end first."""
        if not text:
            return b""
        text = (SPACE + text).replace(" ", SPACE)
        if not self.splits:
            return np.array(self.ids(text), "<i4").tobytes()
        return b"".join(map(self.words.__getitem__, WORD.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(" ")


_loaded: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One a Python worker."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def id_lists(raw: list[bytes]) -> pa.Array:
    """Lists of ids from their bytes."""
    ends = np.cumsum([0, *(len(x) // 4 for x in raw)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4")))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) a row."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in steps(batch, 1, 1 << 20):
                raw = [c.encode_bytes(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(raw)], names=["id", "ids"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(given, run, f"id {dict(given.dtypes)['id']}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) a row; NULL ids give ''."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [c.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    given = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return in_arrow(given, run, f"id {dict(given.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, n_ids, ids_sha256, restored) a row: encoded, decoded again and compared. The digest is of
    the ids as 32-bit numbers, little end first."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in steps(batch, 1, 1 << 20):
                texts = part.column(1).to_pylist()
                raw = [c.encode_bytes(t) for t in texts]
                same = [c.decode(np.frombuffer(x, "<i4").tolist()) == (t or "") for x, t in zip(raw, texts, strict=True)]
                digest = [hashlib.sha256(x).hexdigest() for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(raw), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], names=["id", "ids", "n_ids", "ids_sha256", "restored"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return in_arrow(given, run, f"id {dict(given.dtypes)['id']}, ids array<int>, n_ids bigint, ids_sha256 string, restored boolean").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), f"{TOKENIZERS}/{MODEL}").drop("ids")
