"""Language-model scoring: Katz backoff with Good-Turing discounts, counted into partitioned n-gram tables.

    p(w | c) = d(r) r / N(c)                 if the n-gram c w occurs r > 0 times in the training rows
             = alpha(c) p(w | c')            otherwise; c' is c without its first word
    alpha(c) = (1 - sum of the above) / (1 - sum of p(w | c') over the same words)
    p(w)     = d(r) r / N,  and what these leave for the one unseen word type

A context that was never followed by anything hands over to c' as it is, so each distribution sums to 1 over the
vocabulary and the unseen type.  ``d`` are Katz's discounts up to 5 occurrences (absolute discounts where the counts of
counts do not allow them).  Every n-gram of the training rows is kept, at every size.  A text begins after an end token.

Counts never travel as one row a token.  Documents are packed into blocks of about a million tokens, in a table
bucketed by block.  A level (words, then n-grams by length) asks: each block sends its distinct words, or its distinct
pairs of context and word, as lists dealt to buckets.  A bucket merges the lists of all blocks, counts, writes its share of
the level's table, and answers each list in its own order; answers meet their blocks without moving those.  What a
bucket has counted gets numbers, small for frequent words, and pairs travel as ascending numbers, about 3 bytes each.
Contexts of over ``HOT_SHARE`` of the tokens are split by word; there are at most 1 / HOT_SHARE of those a level.

``train`` leaves the tables in a folder, partitioned by level: keys and counts of words; contexts, words and counts of
n-grams; contexts and their backoff weights.  ``load`` opens them in a later job and ``score`` scores other texts with
them.  ``scored`` does both for one table at once.

Defined results: a null or empty text is one end token; rows that repeat an id are documents of their own; rows
without an id are training rows; an empty table gives no rows; if nothing is held in, the model knows no word
and gives the unseen type probability 1.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vecwords as v
from .scratch import bucketed, materialise, python_ready, scratch_path

ORDER = 2
END = 0x0123456789ABCDEF
HOT_SHARE = 1e-3
SALTS = 64
K = 5
#: Tokens of a block, and blocks for each bucket beyond the least number of buckets.
BLOCK_TOKENS = 1_000_000
BLOCKS_A_BUCKET = 2
_U = np.uint64
FOLDS = 5


# numbers as bytes


def _zip(a: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _zip_planes(a: np.ndarray) -> bytes:
    """Whole numbers by their bytes' places: the high bytes of small numbers vanish."""
    return _zip(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def _unzip_planes(b: bytes) -> np.ndarray:
    planes = _unzip(b, np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(planes).view("<u8").ravel().astype(np.int64)


def _heads(u: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)


def _deltas(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Numbers that ascend from each head on, as steps; heads stay."""
    d = np.diff(x, prepend=0)
    d[heads] = x[heads]
    return d


def _summed(d: np.ndarray, heads: np.ndarray) -> np.ndarray:
    x = np.cumsum(d)
    if len(heads):
        x -= np.repeat(x[heads] - d[heads], np.diff(heads, append=len(d)))
    return x


# discounts


def discounts(hist: list[int]) -> np.ndarray:
    """d[0..K]: Katz's discounts; d[r] = 1 beyond K.  Falls back on absolute discounting."""
    n = np.array([0, *hist], float)
    d = np.ones(K + 1)
    if (n[1:] > 0).all():
        common = (K + 1) * n[K + 1] / n[1]
        r = np.arange(1, K + 1)
        katz = ((r + 1) * n[2 : K + 2] / n[1 : K + 1] / r - common) / (1 - common) if common < 1 else np.zeros(K)
        if (katz > 0).all() and (katz <= 1).all():
            d[1:] = katz
            return d
    b = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.5
    d[1:] = 1 - min(max(b, 0.05), 0.95) / np.arange(1, K + 1)
    return d


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= K, d[np.minimum(c, K)], 1.0) * c


def _hist(c: np.ndarray) -> list[int]:
    return [int((c == r).sum()) for r in range(1, K + 2)]


class Words:
    """The unigram level: probabilities by count, and the mass of the unseen type."""

    def __init__(self, n: int, types: int, hist: list[int]):
        self.n, self.types, self.d = n, types, discounts(hist)
        self.unseen = 1.0
        if n:
            lost = sum((1 - self.d[r]) * r * hist[r - 1] for r in range(1, K + 1))
            self.unseen = max(lost, 0.5) / n
            self.scale = (1 - self.unseen) / max((n - lost) / n, 1e-300)
        else:
            self.scale = 1.0
        self.hot = max(n * HOT_SHARE, 2)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.scale * _discounted(c, self.d) / max(self.n, 1), self.unseen)


@dataclass
class Grams:
    """What is known of all n-grams of one length: discounts, and statistics of the split contexts by number."""

    d: np.ndarray
    hot: dict[int, np.ndarray]

    @property
    def weight(self) -> np.ndarray:
        """Mass of an n-gram by count: 1 to K, and one occurrence of those beyond."""
        return np.concatenate([self.d[1:] * np.arange(1, K + 1), [1.0]])


@dataclass
class Model:
    """Opened tables: a folder, the buckets that its keys are dealt to, and the small numbers of each level."""

    path: str
    buckets: int
    order: int = ORDER
    words: Words | None = None
    grams: list[Grams] = field(default_factory=list)


def _backoff(taken: np.ndarray, shared: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, occurrences of the context); if nothing was discounted, one occurrence more is left for the rest."""
    total = np.maximum(total.astype(float), 1)
    total = np.where(taken > total - 1e-6, total + 1, total)
    return (1 - taken / total) / np.maximum(1 - shared, 1e-12), total


# blocks


def held_out(ids) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % FOLDS == 1 for x in ids], bool)


BLOCK = "block bigint, ids binary, known binary, lens binary, vocab binary, counts binary, tokens binary"


def _block_of(part: int, k: int, ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
    lens = np.array([len(x) for x in texts], np.int64)
    vocab, at, n = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")  # frequent words first, so places are small
    place = np.empty(len(vocab), np.int64)
    place[order] = np.arange(len(vocab))
    at = place[at]
    counts = np.bincount(at[np.repeat(~held_out(ids), lens)], minlength=len(vocab))
    row = {
        "block": [(part << 32) + k],
        "ids": [_zip(np.array([x or 0 for x in ids], np.int64))], "known": [_zip(np.array([x is not None for x in ids]))],
        "lens": [_zip_planes(lens)], "vocab": [vocab[order].tobytes()], "counts": [_zip_planes(counts)], "tokens": [_zip_planes(at)],
    }
    kinds = [pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row.values(), kinds)], names=list(row))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about ``BLOCK_TOKENS`` tokens, whatever the length of the texts; a longer text is a block of its own."""
    part, k, end = TaskContext.get().partitionId(), 0, np.array([END], _U)
    ids: list = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        names = batch.column("doc_id").to_pylist()
        for i, h in v.word_hashes(batch.column("text"), lower=True):
            if ids and size + len(h) > BLOCK_TOKENS:
                yield _block_of(part, k, ids, texts)
                ids, texts, size, k = [], [], 0, k + 1
            ids.append(names[i])
            texts.append(np.concatenate([h, end]))
            size += len(h) + 1
    if ids:
        yield _block_of(part, k, ids, texts)


def _block_ids(block: dict) -> list:
    return [x if y else None for x, y in zip(_unzip(block["ids"], np.int64).tolist(), _unzip(block["known"], bool).tolist())]


def _split(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places in order) for the buckets that have any."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (v.mix64(h ^ _U(0x5DEECE66D)) % _U(buckets)).astype(np.int64)


# a level's rows: answers to blocks (one for each bucket and block) and a bucket's share of the table

LEVEL = (
    "kind string, bucket int, block bigint, counts binary, numbers binary, stats binary, shared binary, "
    "keys binary, runs binary, words binary, totals binary, types bigint, tokens bigint, hist array<bigint>, hot binary"
)
_BINARY = ("counts", "numbers", "stats", "shared", "keys", "runs", "words", "totals", "hot")
_NAMES = [x.split()[0] for x in LEVEL.split(", ")]
_TYPES = {"kind": pa.string(), "bucket": pa.int32(), "block": pa.int64(), "types": pa.int64(), "tokens": pa.int64(), "hist": pa.list_(pa.int64())} | {c: pa.binary() for c in _BINARY}


def _rows(rows: list[dict]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in _NAMES], names=_NAMES)


def _cuts(lists: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([len(x) for x in lists])[:-1]


# words

ASK_WORDS = "bucket int, block bigint, keys binary, counts binary"


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                vocab, counts = np.frombuffer(block["vocab"], _U), _unzip_planes(block["counts"])
                rows = [(b, vocab[at].tobytes(), _zip_planes(counts[at])) for b, at in _split(_bucket_of(vocab, buckets), buckets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([block["block"]] * len(rows), pa.int64()),
                     pa.array([k for _, k, _ in rows], pa.binary()), pa.array([c for _, _, c in rows], pa.binary())],
                    names=["bucket", "block", "keys", "counts"],
                )

    return run


def _answer_words(asked: pa.Table, bucket: int, buckets: int, keys: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> list[dict]:
    lists = [np.frombuffer(x, _U) for x in asked.column("keys").to_pylist()]
    every = np.concatenate(lists)
    at = np.minimum(np.searchsorted(keys, every), max(len(keys) - 1, 0))
    known = keys[at] == every if len(keys) else np.zeros(len(every), bool)
    c = np.where(known, counts[at] if len(keys) else 0, 0)
    n = np.where(known, numbers[at] if len(keys) else 0, len(keys) * buckets + bucket)  # one number for all words not in the table
    blocks = asked.column("block").to_pylist()
    return [
        {"kind": "answer", "bucket": bucket, "block": b, "counts": _zip_planes(x), "numbers": _zip_planes(y)}
        for b, x, y in zip(blocks, np.split(c, _cuts(lists)), np.split(n, _cuts(lists)))
    ]


def _count_words(buckets: int):
    def run(asked: pa.Table) -> pa.Table:
        """The training counts of one bucket's words over all blocks, and its answers."""
        keys, at = np.unique(np.concatenate([np.frombuffer(x, _U) for x in asked.column("keys").to_pylist()]), return_inverse=True)
        own = np.concatenate([_unzip_planes(x) for x in asked.column("counts").to_pylist()])
        total = np.bincount(at, weights=own, minlength=len(keys)).astype(np.int64)
        bucket = asked.column("bucket")[0].as_py()
        number = np.empty(len(keys), np.int64)
        number[np.lexsort((keys, -np.bincount(at, minlength=len(keys)), -total))] = np.arange(len(keys))
        number = number * buckets + bucket
        share = {
            "kind": "table", "bucket": bucket, "keys": keys.tobytes(), "counts": _zip_planes(total), "numbers": _zip_planes(number),
            "types": int((total > 0).sum()), "tokens": int(total.sum()), "hist": _hist(total),
        }
        return _rows([share, *_answer_words(asked, bucket, buckets, keys, total, number)])

    return run


def _look_words(buckets: int):
    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _rows([])
        none = np.zeros(0, np.int64)
        share = table.to_pylist()[0] if table.num_rows else None
        held = (np.frombuffer(share["keys"], _U), _unzip_planes(share["counts"]), _unzip_planes(share["numbers"])) if share else (none.astype(_U), none, none)
        return _rows(_answer_words(asked, asked.column("bucket")[0].as_py(), buckets, *held))

    return run


# n-grams


@dataclass
class _State:
    """A block as far as its levels are answered: by token its probability, its word and its context."""

    lens: np.ndarray
    tokens: np.ndarray  # place of the word in the block's vocabulary, by number
    word_numbers: np.ndarray
    word_counts: np.ndarray
    p: np.ndarray
    context: np.ndarray  # place of the context in the table of contexts, -1 without one
    context_numbers: np.ndarray
    context_counts: np.ndarray


def _begin(block: dict, answers: dict[int, tuple], model: Model) -> _State:
    vocab = np.frombuffer(block["vocab"], _U)
    counts, numbers = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
    for b, at in _split(_bucket_of(vocab, model.buckets), model.buckets):
        counts[at], numbers[at] = (_unzip_planes(x) for x in answers[b][:2])
    by_number = np.argsort(numbers, kind="stable")
    rank = np.empty(len(vocab), np.int64)
    rank[by_number] = np.arange(len(vocab))
    lens = _unzip_planes(block["lens"])
    tokens = rank[_unzip_planes(block["tokens"])]
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lens) - lens] = rank[np.flatnonzero(vocab == _U(END))[0]]
    numbers, counts = numbers[by_number], counts[by_number]
    return _State(lens, tokens, numbers, counts, model.words.p(counts)[tokens], before, numbers, counts)


@dataclass
class _Pairs:
    """Distinct pairs of context and word in a block, ordered by their numbers, and how tokens use them."""

    used: np.ndarray
    use: np.ndarray
    context: np.ndarray
    word: np.ndarray
    bucket: np.ndarray
    hot: np.ndarray


def _pairs(s: _State, model: Model) -> _Pairs:
    used = np.flatnonzero((s.context >= 0) & (s.context_counts[s.context] > 0))
    key, use = np.unique(s.context[used] * len(s.word_numbers) + s.tokens[used], return_inverse=True)
    u, w = key // len(s.word_numbers), key % len(s.word_numbers)
    hot = s.context_counts[u] >= model.words.hot
    salt = np.where(hot, s.word_numbers[w] % SALTS + 1, 0)
    bucket = _bucket_of((s.context_numbers[u] * (SALTS + 1) + salt).astype(_U), model.buckets)
    return _Pairs(used, use, u, w, bucket, hot)


def _own(block: dict, s: _State, pairs: _Pairs) -> np.ndarray:
    """Training counts of a block's distinct pairs in the block."""
    train = np.repeat(~held_out(_block_ids(block)), s.lens)[pairs.used]
    return np.bincount(pairs.use[train], minlength=len(pairs.context))


def _follow(s: _State, pairs: _Pairs, answers: dict[int, tuple], grams: Grams, model: Model, last: bool) -> _State:
    """The state after a level's answers: probabilities one level higher, contexts one word longer."""
    r, numbers = np.zeros(len(pairs.context), np.int64), np.zeros(len(pairs.context), np.int64)
    taken, shared = np.zeros(len(s.context_numbers)), np.zeros(len(s.context_numbers))
    for b, at in _split(pairs.bucket, model.buckets):
        counts, ids, stats, low = answers[b]
        r[at] = _unzip_planes(counts)
        if not last:
            numbers[at] = _unzip_planes(ids)
        mine = pairs.context[at][_heads(pairs.context[at])]
        taken[mine], shared[mine] = _unzip_planes(stats).reshape(-1, K + 1) @ grams.weight, _unzip(low, np.float64)
    for u in np.unique(pairs.context[pairs.hot]).tolist():
        stats = grams.hot.get(int(s.context_numbers[u]))
        if stats is not None:
            taken[u], shared[u] = stats[: K + 1] @ grams.weight, stats[K + 1]
    alpha, total = _backoff(taken, shared, s.context_counts)
    seen, u = r[pairs.use] > 0, pairs.context[pairs.use]
    p = s.p.copy()
    p[pairs.used] = np.where(seen, (_discounted(r, grams.d) / total[pairs.context])[pairs.use], alpha[u] * s.p[pairs.used])
    if last:
        return _State(s.lens, s.tokens, s.word_numbers, s.word_counts, p, s.context, s.context_numbers, s.context_counts)
    by_number = np.argsort(numbers, kind="stable")
    rank = np.empty(len(numbers), np.int64)
    rank[by_number] = np.arange(len(numbers))
    context = np.full(len(s.tokens), -1, np.int64)
    context[pairs.used] = rank[pairs.use]
    moved = np.full(len(s.tokens), -1, np.int64)
    moved[1:] = context[:-1]
    moved[np.cumsum(s.lens) - s.lens] = -1  # a text's first token has no longer context
    return _State(s.lens, s.tokens, s.word_numbers, s.word_counts, p, moved, numbers[by_number], r[by_number])


ASK_PAIRS = "bucket int, block bigint, contexts binary, runs binary, totals binary, words binary, own binary, lower binary"


def _answers_of(table: pa.Table) -> dict[int, dict[int, tuple]]:
    """Answers of one block by level and bucket."""
    out: dict[int, dict[int, tuple]] = {}
    for level, b, *rest in zip(*(table.column(c).to_pylist() for c in ("level", "bucket", "counts", "numbers", "stats", "shared"))):
        out.setdefault(level, {})[b] = tuple(rest)
    return out


def _ask_pairs(model: Model, level: int):
    """What a block asks of the n-grams of ``level`` words: contexts, their words, counts and lower probabilities."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block in left.to_pylist():
            answers = _answers_of(right)
            s = _begin(block, answers[1], model)
            for k in range(2, level):
                s = _follow(s, _pairs(s, model), answers[k], model.grams[k - 2], model, False)
            pairs = _pairs(s, model)
            own = _own(block, s, pairs)
            lower = np.zeros(len(pairs.context))
            lower[pairs.use] = s.p[pairs.used]
            for b, at in _split(pairs.bucket, model.buckets):
                heads = _heads(pairs.context[at])
                c = pairs.context[at][heads]
                low = _zip_planes(s.word_counts[pairs.word[at]]) if level == 2 else _zip(lower[at])
                rows.append((
                    b, block["block"], _zip_planes(_deltas(s.context_numbers[c], np.zeros(0, np.int64))), _zip_planes(np.diff(heads, append=len(at))),
                    _zip_planes(s.context_counts[c]), _zip_planes(_deltas(s.word_numbers[pairs.word[at]], heads)), _zip_planes(own[at]), low,
                ))
        kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
        columns = list(zip(*rows)) if rows else [[] for _ in kinds]
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in ASK_PAIRS.split(", ")])

    return run


def _asked_pairs(asked: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Contexts, runs and words of each list."""
    of = lambda name: [_unzip_planes(x) for x in asked.column(name).to_pylist()]
    contexts, runs = [np.cumsum(x) for x in of("contexts")], of("runs")
    return contexts, runs, [_summed(x, np.cumsum(r) - r) for x, r in zip(of("words"), runs)]


def _answer_pairs(asked: pa.Table, bucket: int, share: dict) -> list[dict]:
    """Counts, numbers and context statistics as each block asked for them."""
    contexts, runs, words = _asked_pairs(asked)
    names, vocabulary = share["names"], np.unique(share["w"])
    at = lambda all_, x: np.minimum(np.searchsorted(all_, x), max(len(all_) - 1, 0))
    c = np.concatenate(contexts)
    ci = at(names, c)
    there = names[ci] == c if len(names) else np.zeros(len(c), bool)
    u, w = np.repeat(ci, np.concatenate(runs)), np.concatenate(words)
    wi = at(vocabulary, w)
    ok = np.repeat(there, np.concatenate(runs)) & (vocabulary[wi] == w if len(vocabulary) else False)
    table = share["u"] * len(vocabulary) + at(vocabulary, share["w"])
    ti = at(table, u * len(vocabulary) + wi)
    ok &= table[ti] == u * len(vocabulary) + wi if len(table) else False
    r, number = (np.where(ok, share[x][ti] if len(table) else 0, 0) for x in ("r", "number"))
    number = np.where(ok, number, share["beyond"])
    stats = np.where(there[:, None], share["stats"][ci] if len(names) else 0, 0)
    shared = np.where(there, share["shared"][ci] if len(names) else 0, 0.0)
    rows = []
    for b, x, y, z, low in zip(asked.column("block").to_pylist(), np.split(r, _cuts(words)), np.split(number, _cuts(words)), np.split(stats, _cuts(contexts)), np.split(shared, _cuts(contexts))):
        rows.append({"kind": "answer", "bucket": bucket, "block": b, "counts": _zip_planes(x), "numbers": _zip_planes(y) if share["numbered"] else None, "stats": _zip_planes(z.ravel()), "shared": _zip(low)})
    return rows


def _count_pairs(model: Model, level: int):
    numbered = level < model.order

    def run(asked: pa.Table) -> pa.Table:
        """Counts of the n-grams of one bucket, and for each context what its seen words take of the mass."""
        contexts, runs, words = _asked_pairs(asked)
        totals = np.concatenate([_unzip_planes(x) for x in asked.column("totals").to_pylist()])
        every = np.concatenate(contexts)
        names, first, which = np.unique(every, return_index=True, return_inverse=True)
        u, w = np.repeat(which, np.concatenate(runs)), np.concatenate(words)
        own = np.concatenate([_unzip_planes(x) for x in asked.column("own").to_pylist()])
        low = asked.column("lower").to_pylist()
        lower = model.words.p(np.concatenate([_unzip_planes(x) for x in low])) if level == 2 else np.concatenate([_unzip(x, np.float64) for x in low])
        order = np.lexsort((w, u))
        new = np.concatenate([[True], (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])])[: len(order)]
        group = np.cumsum(new) - 1
        r = np.bincount(group, weights=own[order]).astype(np.int64)
        head = order[new]
        seen = np.flatnonzero(r)
        gu = u[head][seen]
        stats = np.zeros((len(names), K + 1))
        np.add.at(stats, (gu, np.minimum(r[seen], K + 1) - 1), np.where(r[seen] > K, r[seen], 1))
        shared = np.bincount(gu, weights=lower[head][seen], minlength=len(names))
        bucket = asked.column("bucket")[0].as_py()
        number = np.empty(len(r), np.int64)
        number[np.argsort(-r, kind="stable")] = np.arange(len(r))
        number = number * model.buckets + bucket
        hot = totals[first] >= model.words.hot
        hot_rows = b"".join([names[hot].tobytes(), np.column_stack([stats[hot], shared[hot]]).tobytes()]) if hot.any() else None
        share = {"names": names, "u": u[head], "w": w[head], "r": r, "number": number, "stats": stats, "shared": shared, "beyond": len(r) * model.buckets + bucket, "numbered": numbered}
        kept = _heads(gu)
        table = {
            "kind": "table", "bucket": bucket, "keys": _zip_planes(_deltas(names[gu][kept], np.zeros(0, np.int64))), "runs": _zip_planes(np.diff(kept, append=len(gu))),
            "words": _zip_planes(_deltas(w[head][seen], kept)), "counts": _zip_planes(r[seen]), "totals": _zip_planes(totals[first][gu][kept]),
            "numbers": _zip_planes(number[seen]) if numbered else None, "stats": _zip_planes(stats[gu[kept]].ravel()), "shared": _zip(shared[gu[kept]]), "hist": _hist(r), "hot": hot_rows,
        }
        return _rows([table, *_answer_pairs(asked, bucket, share)])

    return run


def _share_of(row: dict, bucket: int, model: Model, numbered: bool) -> dict:
    """A bucket's share of an n-gram table, read back."""
    runs = _unzip_planes(row["runs"])
    names = np.cumsum(_unzip_planes(row["keys"]))
    r = _unzip_planes(row["counts"])
    return {
        "names": names, "u": np.repeat(np.arange(len(names)), runs), "w": _summed(_unzip_planes(row["words"]), np.cumsum(runs) - runs), "r": r,
        "number": _unzip_planes(row["numbers"]) if numbered else np.zeros(len(r), np.int64), "stats": _unzip_planes(row["stats"]).reshape(-1, K + 1).astype(float),
        "shared": _unzip(row["shared"], np.float64), "beyond": (1 << 40) * model.buckets + bucket, "numbered": numbered,
    }


def _look_pairs(model: Model, level: int):
    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _rows([])
        none = np.zeros(0, np.int64)
        empty = {"keys": _zip_planes(none), "runs": _zip_planes(none), "words": _zip_planes(none), "counts": _zip_planes(none), "numbers": _zip_planes(none), "stats": _zip_planes(none), "shared": _zip(none.astype(float))}
        bucket = asked.column("bucket")[0].as_py()
        row = table.to_pylist()[0] if table.num_rows else empty
        return _rows(_answer_pairs(asked, bucket, _share_of(row, bucket, model, level < model.order)))

    return run


def _weights(model: Model, level: int):
    """Contexts of an n-gram table and their backoff weights; those of split contexts are among the model's small numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = model.grams[level - 2]
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                totals = _unzip_planes(row["totals"])
                alpha, _ = _backoff(_unzip_planes(row["stats"]).reshape(-1, K + 1) @ grams.weight, _unzip(row["shared"], np.float64), totals)
                whole = totals < model.words.hot
                out.append((row["bucket"], _zip_planes(_deltas(np.cumsum(_unzip_planes(row["keys"]))[whole], np.zeros(0, np.int64))), _zip(alpha[whole].astype(np.float32))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "contexts", "weights"])

    return run


# scores

SCORE = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(model: Model):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for block in left.to_pylist():
            answers = _answers_of(right)
            s = _begin(block, answers[1], model)
            for k in range(2, model.order + 1):
                s = _follow(s, _pairs(s, model), answers.get(k, {}), model.grams[k - 2], model, k == model.order)
            c = s.word_counts[s.tokens]
            base = np.log10((c + 0.5) / (model.words.n + 0.5 * (model.words.types + 1)))
            start, ids = np.cumsum(s.lens) - s.lens, _block_ids(block)
            out.append((
                ids, held_out(ids), s.lens, np.add.reduceat((c > 0).astype(np.int64), start), np.full(len(ids), model.words.n),
                np.add.reduceat(base, start), np.add.reduceat(np.log10(np.maximum(s.p, 1e-300)), start),
            ))
        columns = [list(itertools.chain.from_iterable(x)) for x in zip(*out)] if out else [[] for _ in range(7)]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in SCORE.split(", ")])

    return run


class _Whole:
    """Rows are whole blocks inside: a few of them make an Arrow batch."""

    KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.usual = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, "4")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.KEY, self.usual)


def _packed(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    with python_ready(spark, 500):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return bucketed(texts.mapInArrow(_blocks, BLOCK), "blocks", "block", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(LEVEL).parquet(path).where(F.col("kind") == kind)


def _run(blocks: DataFrame, model: Model, learn: bool) -> DataFrame:
    """Ask and answer level by level; the scores of the blocks' documents.  ``learn``: count first, else look up."""
    spark = blocks.sparkSession
    answers = None

    def level_of(asked: DataFrame, level: int, count, look) -> DataFrame:
        nonlocal answers
        path = f"{model.path}/level={level}"
        if learn:
            asked.groupBy("bucket").applyInArrow(count, LEVEL).write.partitionBy("kind").parquet(path)
            found = _kind(spark, path, "answer")
        else:
            table = _kind(spark, path, "table")
            found = materialise(asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(look, LEVEL), "answers")
        found = found.select("block", F.lit(level).alias("level"), "bucket", "counts", "numbers", "stats", "shared")
        answers = found if answers is None else answers.unionByName(found)
        return _kind(spark, path, "table")

    table = level_of(blocks.select("block", "vocab", "counts").mapInArrow(_ask_words(model.buckets), ASK_WORDS), 1, _count_words(model.buckets), _look_words(model.buckets))
    if learn:
        model.words = Words(*_totals(table))
    for level in range(2, model.order + 1):
        ask = _ask_pairs(model, level)
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, ASK_PAIRS)
        table = level_of(asked, level, _count_pairs(model, level) if learn else None, None if learn else _look_pairs(model, level))
        if learn:
            model.grams.append(Grams(discounts(_totals(table)[2]), _hot_contexts(table)))
            rows = table.select("bucket", "keys", "stats", "shared", "totals")
            rows.mapInArrow(_weights(model, level), "bucket int, contexts binary, weights binary").write.parquet(f"{model.path}/weights/level={level}")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(model), SCORE)


def train(docs: DataFrame, path: str | None = None, order: int = ORDER) -> tuple[Model, DataFrame]:
    """Count the training rows into tables below ``path``: the model, and the scores of all rows."""
    spark = docs.sparkSession
    blocks = _packed(docs)
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count() // BLOCKS_A_BUCKET)
    model = Model(path or scratch_path(spark, "ngrams"), buckets, order)
    with _Whole(spark):
        scores = materialise(_run(blocks, model, True), "scores")
    small = [(model.buckets, order)]
    spark.createDataFrame(small, "buckets int, n int").write.mode("overwrite").parquet(f"{model.path}/model")
    return model, scores


def load(spark: SparkSession, path: str) -> Model:
    """Open the tables that ``train`` has left below ``path``."""
    buckets, order = spark.read.parquet(f"{path}/model").first()
    model = Model(path, buckets, order)
    table = lambda level: _kind(spark, f"{path}/level={level}", "table")
    model.words = Words(*_totals(table(1)))
    model.grams = [Grams(discounts(_totals(table(k))[2]), _hot_contexts(table(k))) for k in range(2, order + 1)]
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs``, scored with the tables of a model; nothing is learned from them."""
    blocks = _packed(docs)
    with _Whole(docs.sparkSession):
        return materialise(_run(blocks, model, False), "scores")


def _totals(table: DataFrame) -> tuple[int, int, list[int]]:
    row = table.agg(F.sum("tokens"), F.sum("types"), *[F.sum(F.get("hist", F.lit(k))) for k in range(K + 1)]).first()
    return int(row[0] or 0), int(row[1] or 0), [int(x or 0) for x in row[2:]]


def _hot_contexts(table: DataFrame) -> dict[int, np.ndarray]:
    """Statistics of the split contexts: at most 1 / HOT_SHARE contexts, from at most SALTS + 1 buckets each."""
    out: dict[int, np.ndarray] = {}
    for row in table.where("hot is not null").select("hot").toLocalIterator():
        raw = bytes(row[0])
        n = len(raw) // (8 * (K + 3))
        names = np.frombuffer(raw[: 8 * n], np.int64)
        stats = np.frombuffer(raw[8 * n :], np.float64).reshape(n, K + 2)
        for name, s in zip(names.tolist(), stats):
            out[name] = out.get(name, 0) + s
    return out


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row for each row of ``docs`` with the base and the model's log10 probability of its text."""
    return train(docs, order=order)[1]


def digest(docs: DataFrame) -> DataFrame:
    return scored(docs)
