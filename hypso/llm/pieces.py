"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Merging pieces by score gives every prefix of a text one last token. `Pieces` finds it for
each position from the left: an automaton gives all pieces that end there, and the one
piece that is compatible with the last token of the prefix before it is stored. The ids
are then read off backwards. Two tokens are compatible if merging their joined text would
leave them apart, which is tested by undoing their last merges from the seam outwards.

No piece has a blank mark after another character, so blanks part a text into segments
that merge on their own. Segments repeat; each worker keeps a bounded store of them.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exact, small_batches, table, with_row

MARK = "▁"
#: Segments that a worker keeps, in each of two generations.
STORE = 200_000


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = size = sp.vocab_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.id = {self.text[i]: i for i in range(size) if not special[i]}
        self.byte = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        if any(MARK in p.lstrip(MARK) for p in self.id) or len(self.byte) != 256:
            raise ValueError("the vocabulary has pieces across blanks or lacks byte pieces")
        probe = " a  Äµﬁ\t　\n b"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model rewrites text before it encodes it")
        # Rank 0 merges first. Characters that no piece stands for rank last and become bytes.
        order = sorted(self.id.values(), key=lambda i: (-sp.get_score(i), i))
        self.rank = dict(zip(order, range(size), strict=False))
        self.known = set("".join(self.id))
        for c in self.known - self.id.keys():
            self.id[c] = len(self.text)
            self.rank[len(self.text)] = len(self.rank) + size
            self.text.append(c)
        self.left, self.right = {}, {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self._split(piece, i):
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.output = {i: (i,) if i < size else tuple(self.byte[b] for b in self.text[i].encode()) for i in self.id.values()}
        self.length = [len(p) for p in self.text]
        self.fits: list[dict[int, bool]] = [{} for _ in self.text]  # by the left token
        self.tested = 0
        self.stored: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.older: dict[str, tuple[str, tuple[int, ...]]] = {}
        blanks = "".join(re.escape(c) for c in "\t\n\r" if c not in self.known)
        self.segments = re.compile(f"{MARK}+[^{MARK}{blanks}]*|[^{MARK}{blanks}]+" + (f"|[{blanks}]" if blanks else ""))

    def merged(self, text: str) -> tuple[list[int | str], tuple[int, int] | None]:
        """Ids by merging the best, then leftmost, pair again and again, and the last pair
        merged. For the vocabulary's own pieces and for runs of blanks."""
        ids: list = [self.id.get(c, c) for c in text]
        after, before, last = [*range(1, len(ids)), None], [None, *range(len(ids) - 1)], None
        queue: list = []

        def offer(k: int | None) -> None:
            if k is None or (n := after[k]) is None or ids[k].__class__ is str or ids[n].__class__ is str:
                return
            if (both := self.id.get(self.text[ids[k]] + self.text[ids[n]])) is not None:
                heapq.heappush(queue, (-self.library.get_score(both), k, ids[k], ids[n], both))

        for k in range(len(ids) - 1):
            offer(k)
        while queue:
            _, k, x, y, both = heapq.heappop(queue)
            n = after[k]
            if ids[k] != x or n is None or ids[n] != y:
                continue
            last, ids[k], ids[n], after[k] = (x, y), both, None, after[n]
            if after[k] is not None:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [i for i in ids if i is not None], last

    def _split(self, piece: str, i: int) -> bool:
        """Remember the last merge that makes the piece; False if merging never makes it."""
        if len(piece) == 1:
            return True
        ids, last = self.merged(piece)
        if ids != [i]:
            return False
        self.left[i], self.right[i] = last
        return True

    def compatible(self, x: int, y: int) -> bool:
        """True if merging the joined text of tokens x and y leaves x and y."""
        found = self.fits[x].get(y)
        if found is None:
            self.tested += 1
            if self.tested > 4 * STORE:
                self.tested = 0
                for row in self.fits:
                    row.clear()
            found = self.fits[x][y] = self._apart(x, y)
        return found

    def _apart(self, x: int, y: int) -> bool:
        """Undo merges next to the seam, the latest first: at no moment may the tokens on both
        sides of it merge sooner than the merge that was undone last."""
        rank, limit = self.rank, 1 << 60
        while True:
            both = self.id.get(self.text[x] + self.text[y])
            if both is not None and rank[both] < limit:
                return False
            splits = [(rank[t], side) for side, t in ((0, x), (1, y)) if t in self.left]
            if not splits:
                return True
            at, side = max(splits, key=lambda s: (s[0], s[1]))
            # of two equal merges the left one comes first, so on the right an equal rank still blocks
            if side == 0:
                limit, x = at, self.right[x]
            else:
                limit, y = at + 1, self.left[y]

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of a segment."""
        if text[1:2] == MARK:  # merges between blanks come after all others, the leftmost first
            word = text.lstrip(MARK)
            rest = self.segment(MARK + word) if word else ()
            blanks = len(text) - len(word) - 1
            if not word or rest[0] == self.id[MARK]:
                blanks, rest = blanks + 1, rest[1:]
            return (*self.merged(MARK * blanks)[0], *rest)
        if self.known.issuperset(text):
            return self._known_segment(text)
        # Characters that no piece has stand alone, as their bytes, and part what is around them.
        out: list[int] = []
        start = 0
        for k, c in enumerate(text):
            if c not in self.known:
                if start < k:
                    out += self._known_segment(text[start:k])
                out += [self.byte[b] for b in c.encode()]
                start = k + 1
        if start < len(text):
            out += self._known_segment(text[start:])
        return tuple(out)

    def _known_segment(self, text: str) -> tuple[int, ...]:
        """The last token of each prefix from the left, then the ids from the right."""
        last: list = [None] * (len(text) + 1)
        fits, compatible = self.fits, self.compatible
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                if end == length:
                    last[end] = token
                else:
                    before = last[end - length]
                    fit = fits[before].get(token)
                    if compatible(before, token) if fit is None else fit:
                        last[end] = token
        parts, at, length, size = [], len(text), self.length, self.size
        while at:
            token = last[at]
            at -= length[token]
            if token < size:
                parts.append(token)
            else:
                parts += reversed(self.output[token])
        parts.reverse()
        return tuple(parts)

    def encode(self, text: str | None) -> tuple[list[int], list[str]]:
        """Ids, and the same as decimal text in parts to be joined by blanks. End id last."""
        end = self.library.eos_id()
        ids: list[int] = []
        words: list[str] = []
        if text:
            stored, older = self.stored, self.older
            for part in self.segments.findall(MARK + text.replace(" ", MARK)):
                found = stored.get(part)
                if found is None:
                    found = older.get(part)
                    if found is None:
                        own = self.segment(part)
                        found = (" ".join(map(str, own)), own)
                    if len(part) <= 40:
                        if len(stored) > STORE:
                            older = self.older = stored
                            stored = self.stored = {}
                        stored[part] = found
                words.append(found[0])
                ids.extend(found[1])
        ids.append(end)
        words.append(str(end))
        return ids, words

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_built: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The vocabulary, built once in each process."""
    name = hashlib.sha256(model).hexdigest()
    if name not in _built:
        _built[name] = Pieces(model)
    return _built[name]


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read once by the driver and sent along; its size is that of a vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """The columns `keep` (all by default) with n_tokens and, unless digests are asked for,
    ids (array<int>, end id last) and decoded; with digests, ids_sha256 and decoded_sha256.

    A null text counts as empty: the end id alone, decoded to the empty text. Very long
    texts are encoded whole, with work in proportion to their length. Rows are independent,
    so repeats get equal results; an empty table gives an empty one. Extra columns pass
    through; one that has the name of an added column is replaced.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    model = model_bytes(path)
    small_batches(docs.sparkSession)
    if digests:
        kind = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        kind = "n_tokens long, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(model)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for value in batch.column("_text"):
                ids, words = vocabulary.encode(value.as_py())
                decoded = vocabulary.decode(ids)
                columns[0].append(len(ids))
                columns[1].append(sha(" ".join(words)) if digests else pa.array(ids, pa.int32()).to_pylist())
                columns[2].append(sha(decoded) if digests else decoded)
            middle = pa.array(columns[1], pa.string() if digests else pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(columns[0], pa.int64()), middle, pa.array(columns[2], pa.string())], names=["_row", *added])

    row = F.struct(*[exact(c) for c in keep] or [F.lit(0).alias("_none")]).alias("_row")
    rows = docs.select(row, exact(text).alias("_text"))
    out = rows.mapInArrow(run, with_row(rows, kind))
    return out.select(*[F.col("_row")[c].alias(c) for c in keep], *added)


def op6_piece_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), keep=["doc_id"], digests=True)
