"""Byte-pair encoding learned from the words of a corpus, and embeddings by token sets and token counts.

Ids: the corpus' bytes in ascending order, then the end of a word, then the unknown byte, then one id for each merge.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import words
from sylva.session import cut, ship

END, UNKNOWN = "</w>", "<unk>"
#: Merges tried at once, and rounds between two cuts of the lineage.
AT_ONCE, CUT_EVERY = 16, 3
#: Up to so many letters of distinct words (256 MB with their places) one task learns all merges; beyond, all tasks do.
TASK_TOKENS = 1 << 25
#: Up to so many possible pairs are counted in a table.
DENSE = 1 << 22


@dataclass
class Tokenizer:
    alphabet: bytes
    tokens: list[bytes]
    rules: list[tuple[int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.ids = {b: i for i, b in enumerate(self.alphabet)}
        self.rank = {(a, b): (n, c) for n, (a, b, c) in reversed(list(enumerate(self.rules)))}

    def encode_word(self, word: str | bytes) -> list[int]:
        """The ids of one word: its bytes and the end of word, merged by the rules in their order."""
        raw = word.encode("utf-8", "replace") if isinstance(word, str) else word
        ids = [self.ids.get(b, len(self.alphabet) + 1) for b in raw] + [len(self.alphabet)]
        while len(ids) > 1:
            found = min((self.rank[p] for p in zip(ids, ids[1:], strict=False) if p in self.rank), default=None)
            if found is None:
                break
            ids = merge(ids, *self.rules[found[0]])
        return ids

    def encode(self, text: str) -> list[list[int]]:
        return [self.encode_word(w) for w in text.split(" ") if w]


def merge(ids: list[int], a: int, b: int, c: int) -> list[int]:
    """Replace a, b by c from left to right."""
    out: list[int] = []
    for x in ids:
        if x == b and out and out[-1] == a:
            out[-1] = c
        else:
            out.append(x)
    return out


def byte_alphabet(docs: DataFrame) -> DataFrame:
    """id, byte, n: the distinct bytes of all words in ascending order."""
    ship(docs.sparkSession)

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total += np.bincount(np.frombuffer((text or "").replace(" ", "").encode("utf-8", "replace"), np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["byte", "n"])

    by = docs.select("text").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n"))
    ids = F.expr("row_number() over (order by byte) - 1")  # at most 256 rows
    return by.select(ids.alias("id"), "byte", "n")


def distinct_words(docs: DataFrame) -> DataFrame:
    """word, n."""
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values and the offsets of a column of lists."""
    offsets = column.offsets.to_numpy()
    return np.asarray(column.flatten(), np.int32), offsets - offsets[0]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def first_tokens(distinct: DataFrame, ids: dict[int, int]) -> DataFrame:
    """tokens, n for distinct words (word, n): byte ids and the end of the word, before any merge."""
    ship(distinct.sparkSession)
    table = np.full(256, len(ids) + 1, np.int32)
    table[list(ids)] = list(ids.values())

    def run(batches):
        for batch in batches:
            column = batch.column("word").cast(pa.binary())
            at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
            raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if len(column) and at[-1] else np.zeros(0, np.uint8)
            at = at - at[0]
            yield pa.RecordBatch.from_arrays([_lists(np.insert(table[raw], at[1:], len(ids)), at + np.arange(len(at))), batch.column("n")], ["tokens", "n"])

    return distinct.mapInArrow(run, "tokens array<int>, n long")


def _side_by_side(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places whose next place belongs to the same word."""
    inside = np.ones(len(values), bool)
    ends = offsets[1:] - 1
    inside[ends[np.diff(offsets) > 0]] = False
    return inside


def pair_counts(tokens: DataFrame) -> DataFrame:
    """a, b, n: how often two ids stand side by side, by (tokens, n); summed within each batch before the shuffle."""
    ship(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            values, offsets = _flat(batch.column("tokens"))
            at = np.flatnonzero(_side_by_side(values, offsets))
            weight = np.repeat(np.array(batch.column("n")), np.diff(offsets))[at]
            pairs, where = np.unique(values[at].astype(np.int64) << 32 | values[at + 1] if len(at) else np.zeros(0, np.int64), return_inverse=True)
            total = np.zeros(len(pairs), np.int64)
            np.add.at(total, where, weight)
            yield pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(total)], ["a", "b", "n"])

    return tokens.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _starts(at: np.ndarray, same: bool) -> np.ndarray:
    """Where merges begin: in a run of one id every other place merges, from the left."""
    if not same or not len(at):
        return at
    start = np.append(True, np.diff(at) != 1)
    first = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
    return at[(at - first) % 2 == 0]


def merge_all(values: np.ndarray, offsets: np.ndarray, a: int, b: int, c: int) -> tuple[np.ndarray, np.ndarray]:
    """merge() on all words of a batch at once."""
    if not len(values):
        return values, offsets
    inside = _side_by_side(values, offsets)
    after = np.append(values[1:], -1)
    at = np.flatnonzero(inside & (values == a) & (after == b))
    at = _starts(at, a == b)
    values = values.copy()
    values[at] = c
    keep = np.ones(len(values), bool)
    keep[at + 1] = False
    return values[keep], np.append(0, np.cumsum(keep))[offsets]


def merged(tokens: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """tokens, n after some merges, in their order."""

    def run(batches):
        for batch in batches:
            values, offsets = _flat(batch.column("tokens"))
            for rule in rules:
                values, offsets = merge_all(values, offsets, *rule)
            yield pa.RecordBatch.from_arrays([_lists(values, offsets), batch.column("n")], ["tokens", "n"])

    return tokens.mapInArrow(run, "tokens array<int>, n long")


def best_pairs(tokens: DataFrame, most: int) -> list[tuple[int, int]]:
    """The next merges, at most so many: the most frequent pair, and those after it in order while no id recurs.

    Ties go to the smaller second id, then the smaller first. A merge changes only counts of pairs with one of its ids,
    and a pair with the new id is no more frequent than the pair of old ids it came from, and loses ties; so pairs that
    share no id with those before them keep both their counts and their places.
    """
    out, seen = [], set()
    for r in pair_counts(tokens).orderBy(F.desc("n"), "b", "a").limit(most).collect():
        if {r.a, r.b} & seen:
            break
        out.append((r.a, r.b))
        seen |= {r.a, r.b}
    return out


def _pair_places(word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The distinct places among at whose next place is in the same word."""
    at = np.sort(at, kind="stable")
    at = at[np.append(True, at[1:] != at[:-1])[: len(at)]]
    at = at[(at >= 0) & (at < len(word) - 1)]
    return at[word[at] == word[at + 1]]


def learn(values: np.ndarray, offsets: np.ndarray, weight: np.ndarray, first: int, most: int) -> list[tuple[int, int, int]]:
    """The next merges, at most so many, of words that fit in one task; new ids count from `first`.

    All pairs are counted once. After that a merge changes the counts of the pairs it touches alone, and a heap holds each
    count that was ever reached; those that have changed since are passed over.
    """
    word = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    values, weight = values.astype(np.int32), weight.astype(np.int64)
    counts: dict[tuple[int, int], int] = {}
    heap: list[tuple[int, int, int]] = []

    width = first + most

    def change(at: np.ndarray, sign: int, into: dict) -> None:
        codes = values[at].astype(np.int64) * width + values[at + 1]
        if width * width <= DENSE:
            total = np.bincount(codes, weight[word[at]])
            codes = np.flatnonzero(total)
            total = total[codes]
        else:
            codes, where = np.unique(codes, return_inverse=True)
            total = np.bincount(where, weight[word[at]], len(codes))
        for code, n in zip(codes.tolist(), total.astype(np.int64).tolist(), strict=True):
            pair = divmod(code, width)
            into[pair] = into.get(pair, 0) + sign * n

    change(_pair_places(word, np.arange(len(word) - 1)), 1, counts)
    heap = [(-n, b, a) for (a, b), n in counts.items()]
    heapq.heapify(heap)
    rules: list[tuple[int, int, int]] = []
    while heap and len(rules) < most:
        n, b, a = heapq.heappop(heap)
        if counts.get((a, b), 0) != -n or not n:
            continue
        c = first + len(rules)
        rules.append((a, b, c))
        at = np.flatnonzero(values[:-1] == a)
        at = _starts(at[(values[at + 1] == b) & (word[at + 1] == word[at])], a == b)
        changed: dict[tuple[int, int], int] = {}
        change(_pair_places(word, np.concatenate([at - 1, at, at + 1])), -1, changed)
        values[at] = c
        keep = np.ones(len(values), bool)
        keep[at + 1] = False
        values, word, at = values[keep], word[keep], at - np.arange(len(at))
        change(_pair_places(word, np.concatenate([at - 1, at])), 1, changed)
        for pair, more in changed.items():
            if more:
                counts[pair] = now = counts.get(pair, 0) + more
                if now:
                    heapq.heappush(heap, (-now, pair[1], pair[0]))
    return rules


def train(docs: DataFrame, size: int | None = None, merges: int | None = None, task_tokens: int = TASK_TOKENS) -> Tokenizer:
    """Learn merges until there are `size` tokens, or so many merges, or no pair is left.

    If the alphabet alone is as large as `size` there is no merge. Where the distinct words have at most task_tokens
    letters, one task learns all merges from them; beyond, the words stay distributed, with one aggregation for every few
    merges, and only winning pairs come back. Both ways learn the same.
    """
    alphabet = bytes(r.byte for r in byte_alphabet(docs).orderBy("byte").collect())
    tokens = [bytes([b]) for b in alphabet] + [END.encode(), UNKNOWN.encode()]
    most = merges if size is None else max(0, size - len(tokens)) if merges is None else max(0, min(merges, size - len(tokens)))
    if most is None:
        raise ValueError("give a size or a number of merges")
    now = cut(first_tokens(distinct_words(docs), {b: i for i, b in enumerate(alphabet)}))
    if (now.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= task_tokens:
        rules = _learned(now, len(tokens), most)
    else:
        rules = _learned_in_rounds(now, len(tokens), most)
    for a, b, _ in rules:
        tokens.append(tokens[a] + tokens[b])
    return Tokenizer(alphabet, tokens, rules)


def _learned(tokens: DataFrame, first: int, most: int) -> list[tuple[int, int, int]]:
    def run(batches):
        lists, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        lengths = [np.zeros(0, np.int64)]
        for batch in batches:
            values, offsets = _flat(batch.column("tokens"))
            lists.append(values), lengths.append(np.diff(offsets)), counts.append(np.array(batch.column("n")))
        rules = learn(np.concatenate(lists), np.append(0, np.cumsum(np.concatenate(lengths))), np.concatenate(counts), first, most)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rules], pa.int32()) for k in range(3)], ["a", "b", "c"])

    return [tuple(r) for r in tokens.coalesce(1).mapInArrow(run, "a int, b int, c int").orderBy("c").collect()]


def _learned_in_rounds(now: DataFrame, first: int, most: int) -> list[tuple[int, int, int]]:
    rules: list[tuple[int, int, int]] = []
    rounds = 0
    while len(rules) < most and (pairs := best_pairs(now, min(AT_ONCE, most - len(rules)))):
        rules += [(a, b, first + len(rules) + k) for k, (a, b) in enumerate(pairs)]
        now = merged(now, rules[-len(pairs) :])
        rounds += 1
        if rounds % CUT_EVERY == 0:
            now = cut(now)
    return rules


def encode(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """row_id, tokens: the ids of each text, words joined in order."""
    return _map(docs, tokenizer, "array<int>", lambda t, seen: [x for w in t.split(" ") if w for x in seen[w]])


def binary_embedding(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """row_id, bits: the ids that occur anywhere in a text, ascending."""
    out = _map(docs, tokenizer, "array<int>", lambda t, seen: sorted({x for w in set(t.split(" ")) if w for x in seen[w]}))
    return out.withColumnRenamed("tokens", "bits")


def real_embedding(docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """row_id, token, n: how often each id occurs in a text."""
    return encode(docs, tokenizer).select("row_id", F.explode("tokens").alias("token")).groupBy("row_id", "token").agg(F.count(F.lit(1)).alias("n"))


class _Seen(dict):
    def __init__(self, tokenizer: Tokenizer, most: int = 200_000):
        super().__init__()
        self.tokenizer, self.most = tokenizer, most

    def __missing__(self, word: str) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        self[word] = ids = self.tokenizer.encode_word(word)
        return ids


def _map(docs: DataFrame, tokenizer: Tokenizer, kind: str, fn) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches):
        seen = _Seen(shared.value)
        for batch in batches:
            made = [fn(t or "", seen) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(made, pa.list_(pa.int32()))], ["row_id", "tokens"])

    return docs.select(F.col("row_id").cast("long"), "text").mapInArrow(run, f"row_id long, tokens {kind}")
