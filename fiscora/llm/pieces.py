"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The best segmentation maximises the sum of the pieces' log scores. Characters
without a piece of their own fall back to byte pieces. The whitespace marker
stands for a space, and a text is encoded as if it began with one.

No piece has a marker after another character, so the best segmentation of a
text is that of its chunks (spaces and what follows up to the next space) put
together. A slab's distinct chunks are segmented together: all of them walk the
trie a byte at a time, and the Viterbi step is taken for one position of all
chunks at once. Memory follows the slab.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fiscora.llm.registry import query, table
from fiscora.llm.slabs import fields, powers, BYTE_VALUES, mix, record, slabs

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_PENALTY = 10.0
TEXT_BYTES = 1 << 19        # of a slab; segmenting holds some hundred bytes for each
SPACE_BYTE = 32


class DoubleArray:
    """Trie over bytes in two arrays: the child of state s by byte c is t = base[s] + c if check[t] = s."""

    def __init__(self, words: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final: list[int] = [-1]
        for i, word in enumerate(words):
            node = 0
            for c in word:
                after = children[node].get(c)
                if after is None:
                    after = children[node][c] = len(children)
                    children.append({})
                    final.append(-1)
                node = after
            final[node] = i
        size = 8 * len(children) + 1024
        used = bytearray(size)
        used[0] = 1
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        state = [0] * len(children)
        # A node with one child takes the first free place; others search on from where
        # the last one was put, since places before it are nearly all taken.
        free, cursor, top = 1, 1, 0
        depth_first = [0]
        while depth_first:
            node = depth_first.pop()
            at = state[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                while used[free] or free <= codes[0]:
                    free += 1
                b = free - codes[0]
            else:
                b = max(cursor - codes[0], 1)
                while any(used[b + c] for c in codes):
                    b += 1
                cursor = max(cursor, b + codes[0])
            base[at] = b
            for c in codes:
                child, t = children[node][c], b + c
                used[t] = 1
                check[t], value[t], state[child] = at, final[child], t
                top = max(top, t)
            depth_first.extend(children[node][c] for c in codes)
        keep = top + 257
        self.base, self.check, self.value = base[:keep], check[:keep], value[:keep]

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next state of each, or -1."""
        to = self.base[state] + byte
        return np.where(self.check[to] == state, to, -1)


class Vocabulary:
    """Pieces with log scores, their trie, and the pieces of single bytes."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], usable: list[int]):
        self.text = [p.replace(MARKER, " ").encode() for p in pieces]
        for k, i in enumerate(byte_ids):
            self.text[i] = bytes([k])
        self.scores = np.array(scores)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.usable = np.array(usable, np.int32)
        words = [self.text[i] for i in usable]
        if any(b" " in w.lstrip(b" ") for w in words):
            raise ValueError("a piece has a whitespace marker after another character")
        self.trie = DoubleArray(words)
        self.unknown = float(self.scores[self.usable].min()) - UNKNOWN_PENALTY
        size = np.array([len(t) for t in self.text])
        self.offset = np.concatenate([[0], np.cumsum(size)])
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)

    @classmethod
    def load(cls, path: str = VOCABULARY, scores: str = "zipf") -> Vocabulary:
        """Read a vocabulary file of the sentencepiece library, which is used for nothing else.

        ``file`` takes the scores as they are (a unigram model has log
        probabilities there). A merge list has ranks instead; ``zipf`` reads them
        as log probabilities by Zipf's law.
        """
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        ids = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i)
                                           or model.is_unknown(i) or model.is_unused(i))]
        value = [model.get_score(i) for i in range(n)]
        if scores == "zipf":
            order = sorted(ids, key=lambda i: -value[i])
            total = math.log(sum(1 / (r + 1) for r in range(len(ids))))
            for rank, i in enumerate(order):
                value[i] = -math.log(rank + 1) - total
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([model.id_to_piece(i) for i in range(n)], value, byte_ids, ids)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, then those of start[1] and so on."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def segment(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best ids of every chunk data[start:start + size]: flat ids, offsets, and total scores."""
    trie, n = vocabulary.trie, len(start)
    # Chunks laid out one after the other, each followed by a place for its end.
    begin = np.cumsum(size + 1) - size - 1
    flat = np.zeros(int((size + 1).sum()), np.int64)
    where = _spread(begin, size)
    flat[where] = data[_spread(start, size)]
    end = np.repeat(begin + size, size + 1)
    lead = np.zeros(len(flat), bool)
    lead[where] = (flat[where] & 0xC0) != 0x80
    lead[begin] = True
    stop = lead.copy()
    stop[begin + size] = True
    edges = np.flatnonzero(stop)
    opens = np.flatnonzero(lead)
    char_end = edges[np.searchsorted(edges, opens, "right")]
    # Walk the trie from every character of every chunk.
    place, state, depth = opens.copy(), np.zeros(len(opens), np.int64), 0
    origin = np.arange(len(opens))
    from_, to, piece = [], [], []
    single = np.zeros(len(opens), bool)
    while len(place):
        inside = place < end[place]
        place, state, origin = place[inside], state[inside], origin[inside]
        after = trie.step(state, flat[place])
        alive = after >= 0
        place, state, origin = place[alive] + 1, after[alive], origin[alive]
        found = trie.value[state]
        hit = found >= 0
        from_.append(opens[origin[hit]])
        to.append(place[hit])
        piece.append(vocabulary.usable[found[hit]])
        single[origin[hit][place[hit] == char_end[origin[hit]]]] = True
        depth += 1
    alone = ~single
    from_.append(opens[alone])
    to.append(char_end[alone])
    piece.append(np.full(alone.sum(), -1, np.int32))
    from_, to, piece = (np.concatenate(x) for x in (from_, to, piece))
    gain = np.where(piece >= 0, vocabulary.scores[piece], vocabulary.unknown)
    # One Viterbi step per position inside a chunk, for all chunks together.
    base = np.repeat(begin, size + 1)
    order = np.lexsort((-to, from_ - base[from_]))
    from_, to, piece, gain = from_[order], to[order], piece[order], gain[order]
    local = from_ - base[from_]
    cuts = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1], [True]])) if len(local) else [0]
    best = np.full(len(flat), -np.inf)
    best[begin] = 0.0
    via = np.full(len(flat), -1, np.int64)
    for a, z in zip(cuts[:-1], cuts[1:]):
        value = best[from_[a:z]] + gain[a:z]
        target = to[a:z]
        better = value > best[target]
        best[target[better]] = value[better]
        via[target[better]] = np.arange(a, z)[better]
    # Mark the edges of the best paths, walking back from all ends.
    used = np.zeros(len(from_), bool)
    at = begin + size
    at = at[size > 0]
    while len(at):
        edge = via[at]
        used[edge] = True
        at = from_[edge]
        at = at[at > base[at]]
    chosen = np.flatnonzero(used)
    chosen = chosen[np.argsort(from_[chosen], kind="stable")]
    length = np.where(piece[chosen] >= 0, 1, to[chosen] - from_[chosen])
    ids = np.repeat(piece[chosen], length)
    fallback = ids < 0
    ids[fallback] = vocabulary.byte_ids[flat[_spread(from_[chosen], length)[fallback]]]
    chunk_of = np.searchsorted(begin, from_[chosen], "right") - 1
    per_chunk = np.bincount(chunk_of, weights=length, minlength=n).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(per_chunk)]), best[begin + size]


def encode_texts(vocabulary: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the offsets of each text."""
    raw = b"".join([b" " + t if t else b"" for t in texts])
    size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
    text_start = np.cumsum(size) - size
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = data == SPACE_BYTE
    opens = space.copy()
    opens[1:] &= ~space[:-1]
    opens[text_start[size > 0]] = True
    start = np.flatnonzero(opens)
    length = np.diff(np.append(start, len(data)))
    up, down = powers(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(BYTE_VALUES[data] * up)])
    key = mix((sums[start + length] - sums[start]) * down[start])
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    # Equal hashes must be equal bytes; chunks for which that fails are segmented on their own.
    same = length == length[first[back]]
    other = _spread(start[first[back]], np.where(same, length, 0))
    own = _spread(start, np.where(same, length, 0))
    wrong = np.zeros(len(start), bool)
    wrong[~same] = True
    if len(own):
        differs = data[own] != data[other]
        if differs.any():
            wrong[np.repeat(np.arange(len(start)), np.where(same, length, 0))[differs]] = True
    if wrong.any():
        back[wrong] = len(first) + np.arange(wrong.sum())
        first = np.concatenate([first, np.flatnonzero(wrong)])
    ids, offset, _ = segment(vocabulary, data, start[first], length[first])
    count = np.diff(offset)[back]
    flat = ids[_spread(offset[back], count)]
    text_of = np.searchsorted(text_start + size, start, "right")
    per_text = np.bincount(text_of, weights=count, minlength=len(texts)).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(per_text)])


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Texts of id sequences: pieces joined, markers as spaces, the first space dropped."""
    size = np.diff(vocabulary.offset)[ids]
    data = vocabulary.flat[_spread(vocabulary.offset[ids], size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])[offsets].tolist()
    return [data[s + 1:e] if data[s:s + 1] == b" " else data[s:e] for s, e in zip(ends[:-1], ends[1:])]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` in ``out`` (array of int) in place of the text.

    NULL gives NULL, an empty text no ids. A literal whitespace marker in a text
    is encoded by its bytes, so decoding gives back every text exactly. An input column
    named ``out`` is replaced; repeated rows are encoded alike; an empty table stays empty.
    A task holds a slab of texts, or some 60 bytes per byte of a single longer one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    others = [f for f in docs.schema.fields if f.name not in (text, out)]
    frame = docs.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{text}`").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            missing = fields(batch, text).is_null()
            for slab in slabs(batch, text, TEXT_BYTES):
                texts = [slab.raw[s:e] for s, e in zip(slab.start.tolist(), slab.end.tolist())]
                ids, offsets = encode_texts(shared.value, texts)
                part = batch.slice(int(slab.rows[0]), len(slab))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()),
                    mask=missing.slice(int(slab.rows[0]), len(slab)))
                yield pa.RecordBatch.from_arrays(
                    [*[c for k, c in enumerate(part.columns) if k != at], lists],
                    names=[*[c for k, c in enumerate(part.schema.names) if k != at], out])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], f"`{out}` array<int>"])
    return frame.mapInArrow(run, ddl)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of ``ids`` in ``out``, in place of the ids.

    NULL gives NULL, no ids an empty text. An input column named ``out`` is replaced;
    an empty table stays empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    others = [f for f in rows.schema.fields if f.name not in (ids, out)]
    frame = rows.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{ids}`").alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = fields(batch, ids)
            flat = lists.flatten().to_numpy().astype(np.int64)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decode_ids(shared.value, flat, np.concatenate([[0], np.cumsum(count)]))
            values = [t.decode(errors="replace") if ok.as_py() else None for t, ok in zip(texts, lists.is_valid())]
            at = batch.schema.get_field_index(ids)
            yield pa.RecordBatch.from_arrays(
                [*[c for k, c in enumerate(batch.columns) if k != at], pa.array(values, pa.string())],
                names=[*[c for k, c in enumerate(batch.schema.names) if k != at], out])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], f"`{out}` string"])
    return frame.mapInArrow(run, ddl)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_ids", pa.int64()), ("n_fallback", pa.int64()),
                     ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("exact", pa.bool_())])


def digests(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; sizes and SHA-256 of ids (int32) and of the decoded bytes.

    ``exact`` tells whether the decoded text is the source. NULL counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        is_byte = np.zeros(len(v.text), bool)
        is_byte[v.byte_ids] = True
        for batch in batches:
            for slab in slabs(batch, limit=TEXT_BYTES):
                texts = [slab.raw[s:e] for s, e in zip(slab.start.tolist(), slab.end.tolist())]
                ids, offsets = encode_texts(v, texts)
                fallback = np.concatenate([[0], np.cumsum(is_byte[ids])])[offsets]
                raw, cut = ids.astype("<i4").tobytes(), (4 * offsets).tolist()
                decoded = decode_ids(v, ids, offsets)
                yield record(_DIGEST, fields(batch, "doc_id").take(pa.array(slab.rows)), slab.end - slab.start,
                             np.diff(offsets), np.diff(fallback),
                             [sha256(raw[s:e]).hexdigest() for s, e in zip(cut[:-1], cut[1:])],
                             [sha256(d).hexdigest() for d in decoded], [d == t for d, t in zip(decoded, texts)])

    return frame.mapInArrow(run, "doc_id long, n_bytes long, n_ids long, n_fallback long, "
                                 "ids_sha256 string, decoded_sha256 string, exact boolean")


@query("op6_sentencepiece")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), Vocabulary.load())
