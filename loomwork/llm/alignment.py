"""Alignment of two tokenizers over the same texts by their common token ends."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.words import blocks
from loomwork.session import stage

#: The pairs of a text that end together, with how often they do; the tokens of both sides between two common ends.
_LINKS = "array<struct<a_id:int,b_id:int,n:int>>"
_GROUPS = "array<struct<a:array<int>,b:array<int>>>"
#: Bytes of text that are encoded together; a longer text is encoded alone.
ENCODE_BYTES = 1 << 18
#: Fixed value: how byte-level vocabularies cut a text into pieces that no token crosses.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Every FAN-th entry of a list is searched before those between, which then start where it was found.
FAN = 8


@dataclass
class Vocabulary:
    """Bytes of every token, by id."""

    pieces: pa.Array
    lengths: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes]) -> Vocabulary:
        return cls(pa.array(pieces, pa.large_binary()), np.array([len(p) for p in pieces], np.int64))

    def joined(self, ids: np.ndarray) -> memoryview:
        """The bytes of consecutive tokens."""
        body = self.pieces.take(pa.array(ids)).buffers()[2]
        return memoryview(b"" if body is None else body).cast("B")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies show a printable byte as its own character and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Encoders:
    """Both tokenizers inside a task, made from the bytes of their files.

    The byte-level file is run by ``tiktoken``, which gives the same ids several times faster than its own library where
    ids follow the order of the merges; another file is an error.
    """

    def __init__(self, a_file: bytes, b_file: bytes):
        import tiktoken
        from sentencepiece import SentencePieceProcessor

        entries = json.loads(a_file)
        vocab, merges, byte = entries["model"]["vocab"], entries["model"]["merges"], _byte_of_character()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if entries["pre_tokenizer"]["type"] != "ByteLevel" or entries["normalizer"] or merged != list(range(256, 256 + len(merges))):
            raise ValueError("the first tokenizer must be a plain byte-level vocabulary whose ids follow its merges")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
        self.a = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=b_file)
        self.a_vocabulary = Vocabulary.of([t for t, _ in sorted(ranks.items(), key=lambda e: e[1])])
        self.b_vocabulary = Vocabulary.of([_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of tokens per text: of a blank and the text by A, of the text by B, which adds the blank."""
        a = [self.a.encode_to_numpy(" " + t, disallowed_special=()) for t in texts]
        b = [np.array(x, np.int32) for x in self.b.encode(texts, num_threads=1)]
        return *_flat(a), *_flat(b)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32), np.array([len(x) for x in lists], np.int64)


def _first(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def gallop(short: np.ndarray, rank: np.ndarray, long: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position in ``long`` of the first entry not below each entry of ``short``; there must be one.

    ``rank`` numbers the entries of a list of ``short`` from 0; each is searched in ``long[begin:end]``, which ascends as
    ``short`` does. Steps of 1, 2, 4, ... from the start overshoot the entry, and halving finds it inside the last step.
    The start is the place of an earlier entry of the list, FAN to the power of a level before, so gaps stay short.
    """
    found = np.zeros(len(short), np.int64)
    stride = 1
    while len(rank) and stride * FAN <= rank.max():
        stride *= FAN
    top = True
    while stride:
        if top:
            at = np.flatnonzero(rank % stride == 0)
            low = begin[at].copy()
        else:
            at = np.flatnonzero((rank % stride == 0) & (rank % (stride * FAN) != 0))
            low = found[at - rank[at] % (stride * FAN)]
        found[at] = _search(short[at], long, low, end[at])
        top, stride = False, stride // FAN
    return found


def _search(value: np.ndarray, long: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    high = end - 1
    live, step = np.flatnonzero(long[low] < value), 1
    high[long[low] >= value] = low[long[low] >= value]
    while len(live):  # long[low] < value
        probe = np.minimum(low[live] + step, end[live] - 1)
        below = long[probe] < value[live]
        low[live[below]] = probe[below]
        high[live[~below]] = probe[~below]
        live, step = live[below], 2 * step
    live = np.flatnonzero(high - low > 1)
    while len(live):
        middle = (low[live] + high[live]) >> 1
        below = long[middle] < value[live]
        low[live[below]] = middle[below]
        high[live[~below]] = middle[~below]
        live = live[high[live] - low[live] > 1]
    return high


def common_ends(a_end: np.ndarray, a_count: np.ndarray, b_end: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two end lists of the ends that both have. The lists of a text follow each other; ends ascend over all."""
    a_found, b_found = [], []
    for swap in (False, True):
        (s_end, s_count), (l_end, l_count) = ((b_end, b_count), (a_end, a_count)) if swap else ((a_end, a_count), (b_end, b_count))
        texts = np.flatnonzero(s_count < l_count if swap else s_count <= l_count)
        n = s_count[texts]
        rank = np.arange(n.sum()) - np.repeat(_first(n), n)
        at = np.repeat(_first(s_count)[texts], n) + rank
        begin = np.repeat(_first(l_count)[texts], n)
        place = gallop(s_end[at], rank, l_end, begin, begin + np.repeat(l_count[texts], n))
        same = l_end[place] == s_end[at] if len(at) else np.zeros(0, bool)
        a_found.append((place if swap else at)[same])
        b_found.append((at if swap else place)[same])
    return np.sort(np.concatenate(a_found)), np.sort(np.concatenate(b_found))


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


@dataclass
class Alignment:
    """Tokens of the texts of a block and the place of each group's last token; ``a_last`` and ``b_last`` are the links."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_last: np.ndarray
    b_last: np.ndarray
    text: np.ndarray  # of each group

    def groups(self, n: np.ndarray) -> pa.Array:
        """Groups as lists; ``n`` is the number of groups of every row."""
        both = pa.StructArray.from_arrays([_lists(self.a_ids, np.append(0, self.a_last + 1)), _lists(self.b_ids, np.append(0, self.b_last + 1))], names=["a", "b"])
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), both)

    def written(self, n: np.ndarray, table: pa.Array, a_size: int, b_size: int) -> pa.Array:
        """Groups as text, ``a,a|b;a|b,b``: every token's text carries the sign that follows it, the last one's is cut off."""
        groups = np.arange(len(self.text))
        a_sizes, b_sizes = np.diff(self.a_last, prepend=-1), np.diff(self.b_last, prepend=-1)
        piece = np.zeros(len(self.a_ids) + len(self.b_ids), np.int64)
        a_code, b_code = self.a_ids.astype(np.int64), self.b_ids + np.int64(2 * a_size)
        a_code[self.a_last] += a_size
        b_code[self.b_last] += b_size
        piece[np.arange(len(a_code)) + np.append(0, self.b_last + 1)[np.repeat(groups, a_sizes)]] = a_code
        piece[np.arange(len(b_code)) + (self.a_last + 1)[np.repeat(groups, b_sizes)]] = b_code
        chars = table.take(pa.array(piece))
        data = np.frombuffer(chars.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(chars.buffers()[1], np.int64)[:len(piece) + 1]
        last = np.cumsum(n)[n > 0] - 1  # the last group of every text that has one
        stops = ends[self.a_last[last] + self.b_last[last] + 2]
        size = np.zeros(len(n), np.int64)
        size[n > 0] = np.diff(stops, prepend=0) - 1
        return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(np.delete(data, stops - 1))).cast(pa.string())

    def links(self, n_rows: int, b_size: int) -> pa.Array:
        """The different pairs of each row with how many of its links hold them."""
        pair = self.a_ids[self.a_last].astype(np.int64) * b_size + self.b_ids[self.b_last]
        order = np.lexsort((pair, self.text))
        pair, text = pair[order], self.text[order]
        head = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (text[1:] != text[:-1]))) if len(pair) else pair
        a_id, b_id = np.divmod(pair[head], b_size)
        n = np.diff(np.append(head, len(pair)))
        fields = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a_id, b_id, n)], names=["a_id", "b_id", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[head], np.arange(n_rows + 1)).astype(np.int32)), fields)


def _number_texts(encoders: Encoders) -> pa.Array:
    sides = ((encoders.a_vocabulary, ",|"), (encoders.b_vocabulary, ",;"))
    return pa.array([f"{i}{sign}" for v, signs in sides for sign in signs for i in range(len(v.lengths))], pa.large_string())


def _aligned(shared, written: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*shared.value)
        a_size, b_size = len(encoders.a_vocabulary.lengths), len(encoders.b_vocabulary.lengths)
        table = _number_texts(encoders) if written else None
        for batch in batches:
            for block in blocks(batch.column(0), ENCODE_BYTES):
                rows = batch.slice(block.first, len(block))
                body, at = block.data.tobytes(), block.offsets
                some = np.flatnonzero(np.diff(at))
                raw = [body[at[i]:at[i + 1]] for i in some]
                a_ids, a_count, b_ids, b_count = encoders.encode([x.decode(errors="replace") for x in raw])
                whole = _faithful(raw, encoders.a_vocabulary, a_ids, a_count) & _faithful(raw, encoders.b_vocabulary, b_ids, b_count)
                a_ids, b_ids = a_ids[np.repeat(whole, a_count)], b_ids[np.repeat(whole, b_count)]
                a_count, b_count, some = a_count[whole], b_count[whole], some[whole]
                a_last, b_last = common_ends(np.cumsum(encoders.a_vocabulary.lengths[a_ids]), a_count, np.cumsum(encoders.b_vocabulary.lengths[b_ids]), b_count)
                n_a, n_b, n_groups = (np.zeros(len(block), np.int64) for _ in range(3))
                n_a[some], n_b[some] = a_count, b_count
                n_groups[some] = np.searchsorted(a_last, np.cumsum(a_count)) - np.searchsorted(a_last, _first(a_count))
                found = Alignment(a_ids, b_ids, a_last, b_last, np.repeat(np.arange(len(block)), n_groups))
                groups = found.written(n_groups, table, a_size, b_size) if written else found.groups(n_groups)
                yield pa.RecordBatch.from_arrays([*rows.columns[1:], *map(pa.array, (n_a, n_b, n_groups)), groups, found.links(len(block), b_size)],
                                                 names=[*rows.schema.names[1:], *_RESULTS])

    return run


_RESULTS = ["n_a", "n_b", "n_groups", "groups", "links"]


def _faithful(raw: list[bytes], vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Texts whose tokens give, joined, a blank and the text."""
    data = vocabulary.joined(ids)
    ends = np.append(0, np.cumsum(vocabulary.lengths[ids]))[np.append(0, np.cumsum(counts))]
    return np.array([data[ends[i]:ends[i + 1]] == b" " + x for i, x in enumerate(raw)], bool)


def aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", columns: list[str] | None = None, written: bool = False) -> DataFrame:
    """``docs`` (all columns, or those named) with ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``groups`` and ``links``.

    ``a_path`` is the JSON file of a byte-level vocabulary, ``b_path`` a model read by ``sentencepiece``; the driver
    reads both files and sends them to the tasks (a few MB whatever the input), so executors need no copy. Special tokens
    are never added, and their strings inside a text are ordinary text. A blank and the text is encoded by A, the text by
    B, which adds the blank itself. Byte offsets where a token of both ends are found by galloping: the shorter list of
    ends drives an exponential and then binary search in the longer. They cut both token lists into ``groups``, structs
    ``a`` and ``b`` of the ids between two common ends, or with ``written`` the text ``a1,a2|b1;a3|b2,b3``; the sizes of
    the two lists are the differences of the ranks. Each group's last tokens end together and are a link; ``links`` lists
    the pairs (a_id, b_id) of a row with ``n``, how many of its links hold them.

    Null and empty texts, and texts whose joined token bytes differ from the blank and the text (a model may change
    characters), have no tokens: zeros and empty lists. Texts are encoded whole, about a quarter of a MB at a time; a
    longer one is encoded alone, so memory follows the longest text. Rows are judged one by one, so repeated rows and ids all
    stay, and nothing is shuffled; columns that clash with the result names are replaced; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((_read(a_path), _read(b_path)))
    kept = [c for c in (docs.columns if columns is None else columns) if c not in _RESULTS]
    source = docs.select(F.col(f"`{text_col}`").alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    results = f"n_a bigint, n_b bigint, n_groups bigint, groups {'string' if written else _GROUPS}, links {_LINKS}"
    schema = T.StructType([*source.schema.fields[1:], *T.StructType.fromDDL(results).fields])
    return source.mapInArrow(_aligned(shared, written), schema).toDF(*kept, *_RESULTS)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def link_table(rows: DataFrame, links_col: str = "links") -> DataFrame:
    """(a_id, b_id, n, best): how many links of all rows hold a pair, and whether no pair of that b_id has more.

    Tokens that end together are equal or one is the end of the other, and the shorter one's bytes say which token it is
    (a byte may be two tokens of a vocabulary with byte fallback). So a vocabulary's bytes bound the number of pairs, some
    hundred thousand for 50,000 and 32,000 tokens, whatever the input; pairs are summed in the tasks before they travel.
    """
    pairs = rows.select(F.explode(links_col).alias("l")).groupBy("l.a_id", "l.b_id").agg(F.sum("l.n").alias("n"))
    most = F.max("n").over(Window.partitionBy("b_id"))
    return pairs.withColumn("best", F.col("n") == most)


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, best = shared.value
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            a, b, times = (pc.struct_field(flat, i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            at = np.searchsorted(code, a << 32 | b)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sums = [np.diff(np.append(0, np.cumsum(x[at] * times))[offsets]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, sums)], names=[*batch.schema.names[1:], "n_best", "count_sum"])

    return run


def link_scores(rows: DataFrame, table: DataFrame, links_col: str = "links") -> DataFrame:
    """``rows`` without their links, with ``n_best`` (links whose pair is the best of its b_id) and ``count_sum``.

    ``table`` is the ``link_table`` of these rows; it is bounded by the vocabularies and goes to every task. Rows without
    links get zeros; columns that clash with the result names are replaced.
    """
    known = np.array(table.select((F.shiftleft(F.col("a_id").cast("bigint"), 32) + F.col("b_id")).alias("code"), "n", F.col("best").cast("bigint")).collect(),
                     np.int64).reshape(-1, 3)
    shared = rows.sparkSession.sparkContext.broadcast(tuple(known[np.argsort(known[:, 0])].T.copy()))
    kept = [c for c in rows.columns if c not in (links_col, "n_best", "count_sum")]
    source = rows.select(F.col(links_col).cast(_LINKS).alias("_links"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(kept)])
    schema = T.StructType([*source.schema.fields[1:], *T.StructType.fromDDL("n_best bigint, count_sum bigint").fields])
    return source.mapInArrow(_scored(shared), schema).toDF(*kept, "n_best", "count_sum")


def scored_alignment(rows: DataFrame, links_col: str = "links") -> DataFrame:
    """``rows`` with the scores of their links over the whole table, which is written once and read twice."""
    rows = stage(rows, "links")
    return link_scores(rows, link_table(rows, links_col), links_col)
