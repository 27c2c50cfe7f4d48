"""Passages that repeat across documents, by suffix arrays over words.

1. Each shard (consecutive documents, a bounded number of words) is sorted by Larsson-Sadakane
   refinement, and Kasai's scan gives the common prefixes of its suffix array. Suffixes that share at least
   MIN_WORDS words form a run; in a run only the suffixes of its first document can still be the first
   occurrence in the whole corpus, and all later ones are repeats already. The shard's words are kept in a file.
2. The first suffixes go to partitions by a hash of their MIN_WORDS words, an order that all shards share without a common
   alphabet, as sorted, compressed blocks, one for each shard and partition. A partition merges its blocks by binary search;
   equal neighbours from different documents repeat the one with the smallest doc_id.
3. Each shard gets its repeats back, and compares them word by word with the shard that has the first occurrence. Only
   what is equal there counts, so that a result never rests on a hash of several words.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrove.llm.shared import filesystem, fresh_path, unused
from lexgrove.llm.textbuf import U64, pieces, spans_hash, texts_of, word_hashes, words

MIN_WORDS, SHARD_WORDS = 50, 1 << 19
LANE = 256


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of integers by Larsson-Sadakane: after each round suffixes are sorted by twice as many
    symbols, and only groups that are still equal are sorted again. The last symbol must be unique."""
    n = len(s)
    sa = np.argsort(s, kind="stable")
    v = s[sa]
    head = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(head, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    h = 1
    while len(open_):
        idx = sa[open_]
        group = rank[idx]
        key = group * (n + 1) + rank[idx + h]  # a suffix in an open group never reaches the end within h symbols
        order = np.argsort(key, kind="stable")
        idx, key, group = idx[order], key[order], group[order]
        sa[open_] = idx
        first = np.append(True, key[1:] != key[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(key)))
        rank[idx] = np.repeat(open_[at], size)
        open_ = open_[np.repeat(size > 1, size)]
        h *= 2
    return sa


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Length of the common prefix of sa[i-1] and sa[i] for each i, 0 for i = 0, by Kasai's scan.

    The text is scanned in lanes at once; within a lane each position starts from what the one before left."""
    n = len(s)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    rank = np.empty(n, np.int32)
    rank[sa] = np.arange(n, dtype=np.int32)
    prev = np.full(n, -1, np.int32)
    prev[sa[1:]] = sa[:-1]
    at = np.arange(0, n, LANE)
    stop = np.minimum(at + LANE, n)
    h = np.zeros(len(at), np.int64)
    common = np.zeros(n, np.int32)
    padded = np.append(s, -1)
    while len(at):
        p = prev[at]
        i, j = np.minimum(at + h, n), np.minimum(p + h, n)
        same = (p >= 0) & (padded[i] == padded[j]) & (i < n) & (j < n)
        h = np.where(same, h + 1, h)
        done = ~same
        common[at[done]] = h[done]
        at = at + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        alive = at < stop
        if not alive.all():
            at, stop, h = at[alive], stop[alive], h[alive]
    out[rank] = common
    out[0] = 0
    return out


def shard_firsts(tokens: np.ndarray, start: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """One shard: tokens, first token of each document (and the end), document ids.

    Returns (hash, doc, token) of suffixes that are the first of their k words in this shard,
    and the tokens of those that repeat a smaller doc of it."""
    n, d = len(tokens), len(doc)
    length = np.diff(start)
    row = np.repeat(np.arange(d), length)
    _, sym = np.unique(tokens, return_inverse=True)
    # a unique separator after every document, below all words
    s = np.empty(n + d, np.int64)
    place = np.arange(n) + row
    s[place] = sym + d
    s[start[1:] + np.arange(d)] = np.arange(d)
    back = np.full(n + d, -1, np.int64)
    back[place] = np.arange(n)
    sa = suffix_array(s)
    lcp = common_prefixes(s, sa)
    run = np.cumsum(lcp < k) - 1
    tok = back[sa]
    fits = tok >= 0
    fits[fits] = tok[fits] + k <= start[row[tok[fits]] + 1]
    tok, run = tok[fits], run[fits]
    if not len(tok):
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, z
    owner = doc[row[tok]]
    head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    size = np.diff(np.append(head, len(run)))
    lowest = np.repeat(np.minimum.reduceat(owner, head), size)
    first = owner == lowest
    return window_keys(tokens, tok[first], k), owner[first], tok[first], tok[~first]


def window_keys(tokens: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return spans_hash(tokens, at, at + k)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns as byte planes, which a sorted or narrow column fills with few values, under zstandard."""
    n = len(columns[0])
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() if n else b"" for c in columns]
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=1 + n * 32), 0, []
    for kind in kinds:
        w = np.dtype(kind).itemsize
        plane = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(plane.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * w
    return out


def merge(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Two runs sorted by their first column as one, by binary search of one in the other."""
    at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
    own = np.ones(len(a[0]) + len(b[0]), bool)
    own[at] = False
    out = []
    for x, y in zip(a, b, strict=True):
        z = np.empty(len(own), x.dtype)
        z[own], z[at] = x, y
        out.append(z)
    return tuple(out)


class _Shard:
    """The file of a shard: number of documents, (doc_id, text hash, first token) of each, and 16 bits of the hash of each word."""

    def __init__(self, path: str):
        fs, at = filesystem(path)
        self.file = fs.open_input_file(at)
        self.n = int(np.frombuffer(self.file.read_at(8, 0), np.int64)[0])

    def documents(self) -> np.ndarray:
        return np.frombuffer(self.file.read_at(24 * self.n, 8), np.int64).reshape(3, self.n)

    def words(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(2 * (end - begin), 8 + 24 * self.n + 2 * begin), np.uint16)

    @staticmethod
    def write(path: str, doc: np.ndarray, text: np.ndarray, start: np.ndarray, tokens: np.ndarray) -> None:
        fs, at = filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(at, compression=None) as out:
            out.write(np.concatenate([[len(doc)], doc, text, start]).astype(np.int64).tobytes())
            out.write((tokens >> U64(48)).astype(np.uint16).tobytes())


def equal_windows(own: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """For each window of k words of two equally long stretches, whether they have the same words."""
    wrong = np.concatenate([[0], np.cumsum(own != other)])
    return wrong[k:] == wrong[:-k]


def _same(mine: _Shard, tok: np.ndarray, other: np.ndarray, at: np.ndarray, files: list[str], k: int) -> np.ndarray:
    """Whether the windows at `tok` have the words of those at `at` of the shards files[other]; stretches are read once."""
    order = np.lexsort((tok, at - tok, other))
    t, o, a = tok[order], other[order], at[order]
    head = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1] + 1) | (a[1:] != a[:-1] + 1)))
    ok, shard, which = np.zeros(len(tok), bool), None, -1
    for i, j in zip(head.tolist(), np.append(head[1:], len(t)).tolist(), strict=True):
        if o[i] != which:
            shard, which = _Shard(files[o[i]]), o[i]
        n = j - i + k - 1
        ok[order[i:j]] = equal_windows(mine.words(int(t[i]), int(t[i]) + n), shard.words(int(a[i]), int(a[i]) + n), k)
    return ok


def stretches(docs: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, parts: int | None = None) -> DataFrame:
    """(doc_id, text_hash, start_word, end_word): as repeats, with a hash of the text that has the stretch."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = fresh_path(spark, "shards")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id is not null and text is not null"
    )
    src = src.withColumn("h", F.xxhash64("text"))
    k = min_words

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            for part, t in pieces(batch, "text", 2 << 20):
                h, _, _, row = word_hashes(t)
                held.append((h, np.bincount(row, minlength=len(t)), np.asarray(part.column(0)), np.asarray(part.column(2))))
                size += len(h)
                if size >= shard_words:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        tokens, count, doc, text = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        start = np.concatenate([[0], np.cumsum(count)])
        path = f"{folder}/{uuid.uuid4().hex}"  # a new name for each attempt; only those of attempts that end well are named in rows
        _Shard.write(path, doc, text, start[:-1], tokens)
        key, fd, ft, late = shard_firsts(tokens, start, doc, k)
        del tokens
        order = np.argsort(key)
        key, fd, ft = key[order], fd[order], ft[order].astype(np.int32)
        # the top bits choose the partition, so a sorted list is cut at splitters found by binary search
        edge = np.searchsorted(key, np.array([((p << 64) + parts - 1) // parts for p in range(parts)], U64))
        edge = np.append(edge, len(key))
        rows = [(p, 0, _pack(key[i:j], fd[i:j], ft[i:j])) for p, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if j > i]
        if len(late):
            rows.append((zlib.crc32(path.encode()) % parts, 1, _pack(np.sort(late).astype(np.int32))))
        for i in range(0, len(rows), 16):
            p, kind, blob = zip(*rows[i : i + 16], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(kind, pa.int32()), pa.array([path] * len(p)), pa.array(blob, pa.binary())], names=["part", "kind", "file", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        files: dict[str, int] = {}
        runs, out = [], []
        for kind, path, blob in zip(*(table.column(c).to_pylist() for c in ("kind", "file", "blob")), strict=True):
            if kind == 1:  # repeats inside a shard pass through
                out.append((path, blob, None))
                continue
            key, doc, tok = _unpack(blob, (U64, np.int64, np.int32))
            runs.append((key, doc, tok, np.full(len(key), files.setdefault(path, len(files)), np.int32)))
        while len(runs) > 1:
            runs.sort(key=lambda r: -len(r[0]))
            runs = [merge(runs.pop(), runs.pop()) for _ in range(len(runs) // 2)] + runs
        if runs:
            key, doc, tok, of = runs[0]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(head, len(key)))
            lowest = np.repeat(np.minimum.reduceat(doc, head), size)
            at = np.repeat(np.minimum.reduceat(np.where(doc == lowest, np.arange(len(key)), len(key)), head), size)
            late = np.flatnonzero(doc > lowest)
            late = late[np.lexsort((tok[late], of[late]))]
            names = list(files)
            for own in np.split(late, np.flatnonzero(of[late][1:] != of[late][:-1]) + 1):
                if len(own):
                    used, other = np.unique(of[at[own]], return_inverse=True)
                    out.append((names[of[own[0]]], _pack(tok[own], other.astype(np.int32), tok[at[own]]), [names[i] for i in used]))
        path, blob, used = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"file": pa.array(path, pa.string()), "blob": pa.array(blob, pa.binary()), "files": pa.array(used, pa.list_(pa.string()))})

    def cover(table: pa.Table) -> pa.Table:
        path = table.column("file")[0].as_py()
        mine, files, found = _Shard(path), {}, []
        tok, other, at = [], [], []
        for blob, used in zip(table.column("blob").to_pylist(), table.column("files").to_pylist(), strict=True):
            if used is None:  # repeats inside the shard were compared there
                found.append(_unpack(blob, (np.int32,))[0])
                continue
            t, o, a = _unpack(blob, (np.int32, np.int32, np.int32))
            tok.append(t)
            other.append(np.array([files.setdefault(x, len(files)) for x in used])[o])
            at.append(a)
        if tok:
            tok, other, at = (np.concatenate(x).astype(np.int64) for x in (tok, other, at))
            found.append(tok[_same(mine, tok, other, at, list(files), k)])
        doc, text, start = mine.documents()
        tok = np.unique(np.concatenate(found).astype(np.int64))
        row = np.searchsorted(start, tok, side="right") - 1
        pos = tok - start[row]
        first = np.append(True, (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + k)) if len(tok) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        last = np.append(begin[1:], len(row))[: len(begin)] - 1
        return pa.table({"doc_id": doc[row[begin]], "text_hash": text[row[begin]], "start_word": pos[begin].astype(np.int32), "end_word": (pos[last] + k).astype(np.int32)})

    met = src.mapInArrow(shard, "part int, kind int, file string, blob binary").groupBy("part").applyInArrow(meet, "file string, blob binary, files array<string>")
    return met.groupBy("file").applyInArrow(cover, "doc_id long, text_hash long, start_word int, end_word int")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """Stretches of words that an earlier document has too: (doc_id, start_word, end_word), end exclusive.

    A word is a run without white space (see textbuf). Word p of document d is in a stretch if some window of
    `min_words` words over p also occurs in a document with a smaller doc_id; stretches are maximal. The first
    document of a passage has no row for it. Repeats inside one document are left alone, and rows that share a
    doc_id never repeat one another; each has its own stretches. Null ids, and null, empty or shorter texts, give no row. A text of any length
    is in one shard. Columns other than doc_id and text are ignored, whatever their names. An empty table gives no row.
    Windows are compared word by word: within a shard by all 64 bits of the hash of each word, across shards, among windows whose own 64-bit
    hashes agree, by 16 bits of it.
    """
    return stretches(docs, **how).drop("text_hash")


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs without the stretches of repeats(): same columns, n_chars counted anew; a document of which no word is left goes.

    Rows without a stretch are returned as they are, null ids and null or blank texts included. Of a document that loses a
    stretch, the white space after the stretch goes with it. Rows that share a doc_id lose each its own stretches, and those that share their
    text too are one document. Extra columns stay, whatever their names. An empty table gives an empty one.
    """
    cuts = stretches(docs, **how).distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    names = docs.columns
    key, text_hash, begin, end = (unused(c, names) for c in ("cut_id", "cut_hash", "cut_from", "cut_to"))
    cuts = cuts.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("cuts.start_word").alias(begin), F.col("cuts.end_word").alias(end))
    own = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash))
    both = docs.join(cuts.hint("shuffle_hash"), own, "left").drop(key, text_hash)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = np.flatnonzero(np.asarray(batch.column(begin).is_valid()))
            plain = batch.select(names)
            if not len(lost):
                yield plain
                continue
            yield plain.filter(batch.column(begin).is_null())
            some = batch.take(pa.array(lost))
            t = texts_of(some.column("text"))
            s, e, row = words(t)
            edge = np.searchsorted(row, np.arange(len(t) + 1))
            text, stays = [], []
            for i in range(len(t)):
                ws, we = s[edge[i] : edge[i + 1]], e[edge[i] : edge[i + 1]]
                keep, at = [], int(t.off[i])
                for a, b in zip(some.column(begin)[i].as_py(), some.column(end)[i].as_py(), strict=True):
                    if a >= len(ws):
                        break
                    keep.append(t.data[at : ws[a]].tobytes())
                    at = int(ws[b]) if b < len(ws) else int(t.off[i + 1])
                untouched = not keep  # another row with this doc_id has the stretch
                keep.append(t.data[at : t.off[i + 1]].tobytes())
                text.append(b"".join(keep).decode("utf-8", "replace") if t.valid[i] else None)
                stays.append(untouched or bool(text[-1].strip()))
            out = some.select(names)
            out = out.set_column(names.index("text"), "text", pa.array(text, out.schema.field("text").type))
            if "n_chars" in names:
                j = names.index("n_chars")
                out = out.set_column(j, "n_chars", pa.array([len(x or "") for x in text]).cast(out.schema.field("n_chars").type))
            yield out.filter(pa.array(stays))

    return both.mapInArrow(run, docs.schema)
