"""Scores of a causal self-attention model, trained in numpy on subword ids, beside a unigram base score."""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import ASCII_LOWER, PIECE, slices, stored, word_hashes

#: Where the tokenizer's ranks are, on every machine.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids of the tokenizer, at most.
IDS = 50_257
#: Positions of a window, and those at its start that are context only.
WINDOW, CONTEXT = 32, 8
STEP = WINDOW - CONTEXT
#: Size of vectors, and of each of the three levels of the output: BRANCH ** 3 subwords.
SIZE, BRANCH = 16, 16
SUBWORDS = BRANCH**3
#: Rounds of training, which share all windows of all training documents; in each, the trainers of all partitions start from the mean of the last round.
ROUNDS = 3
BATCH, LEAST_STEPS, RATE = 128, 600, 0.02
#: Trainers' weights are added up in so many groups before they come to the driver.
GROUPS = 16
#: Counts that the chance without its condition stands for, where a condition is rare.
PRIOR = 8.0
#: Word hashes that one task counts, about.
SHARE = 1_000_000
END, START = 0, SUBWORDS


@cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def normal(texts: pd.Series) -> list[bytes]:
    """Words of each text with one space between them, A-Z in lower case; null is empty."""
    return [b" ".join(t.encode("utf-8", "replace").translate(ASCII_LOWER).split()) if isinstance(t, str) else b"" for t in texts]


def squeezed(x: np.ndarray) -> bytes:
    """Bytes of an array, the bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def restored(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


@cache
def leading(path: str) -> np.ndarray:
    """Which ids begin with a space, and so begin a word."""
    enc = encoder(path)
    return np.array([i < enc.n_vocab and enc.decode_single_token_bytes(i)[:1] == b" " for i in range(IDS)])


def spelled(words: list[bytes], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words one after another, each with a space before it, and how many each has."""
    encode = encoder(tokenizer).encode_to_numpy
    if not words:
        return np.zeros(0, np.uint16), np.zeros(0, np.int32)
    ids = encode(" " + b" ".join(words).decode("utf-8", "replace"), disallowed_special=()).astype(np.uint16)
    first = np.flatnonzero(leading(tokenizer)[ids])
    if len(first) == len(words) and first[0] == 0:
        return ids, np.diff(np.append(first, len(ids))).astype(np.int32)
    each = [encode(" " + w.decode("utf-8", "replace"), disallowed_special=()).astype(np.uint16) for w in words]  # white space beyond ASCII stands in words
    return np.concatenate(each), np.array([len(x) for x in each], dtype=np.int32)


def blocks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """A row for each run of documents: their ids, words as numbers, the numbers' hashes, training counts and subword ids."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "text", 4 * PIECE):
                texts = normal(part["text"])
                held = part["held_out"].to_numpy()
                hashes, n_words = word_hashes(texts)
                unique, where, number, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                train = np.bincount(number[np.repeat(~held, n_words)], minlength=len(unique)).astype(np.int32)
                order = np.argsort(-times, kind="stable")
                rank = np.empty(len(unique), dtype=np.uint32)  # frequent words get small numbers, which compress
                rank[order] = np.arange(len(unique), dtype=np.uint32)
                words = b" ".join(t for t in texts if t).split(b" ")
                flat, n_ids = spelled([words[i] for i in where[order].tolist()], tokenizer)
                counts = np.bincount(flat, np.repeat(train[order], n_ids), minlength=IDS)
                seen = np.flatnonzero(counts).astype(np.uint32)
                yield pd.DataFrame(
                    {
                        "block": [uuid.uuid4().hex], "doc_ids": [part["doc_id"].astype("Int64").fillna(0).to_numpy(np.int64).tobytes()], "named": [part["doc_id"].notna().to_numpy().tobytes()],
                        "held": [held.tobytes()], "n_words": [n_words.astype(np.int32).tobytes()], "words": [squeezed(rank[number])], "hashes": [unique.tobytes()], "rank": [squeezed(rank)], "train": [squeezed(train)],
                        "n_ids": [squeezed(n_ids)], "ids": [squeezed(flat)], "seen": [np.stack([seen, counts[seen].astype(np.uint32)]).tobytes()], "n_unique": [len(unique)], "n_train": [int((~held).sum())],
                    }
                )

    schema = "block string, doc_ids binary, named binary, held binary, n_words binary, words binary, hashes binary, rank binary, train binary, n_ids binary, ids binary, seen binary, n_unique long, n_train long"
    return docs.mapInPandas(read, schema)


def counted(table: DataFrame, total: int) -> DataFrame:
    """(block, part, counts, n, v, once, twice, firsts): for each block the training counts of its words of each part of the hashes.

    The rest once for each part: tokens, different words, words seen once and twice, and by the first ids of words their tokens and different words.
    """
    parts = max(1, -(-total // SHARE))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.array([(i << 64) // parts for i in range(1, parts)], dtype=np.uint64)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                h, train = np.frombuffer(r.hashes, np.uint64), restored(r.train, np.int32)
                n_ids = restored(r.n_ids, np.int32).astype(np.int64)
                first = restored(r.ids, np.uint16)[np.cumsum(n_ids) - n_ids][restored(r.rank, np.uint32)]
                at = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                found = [(r.block, p, h[a:b].tobytes(), train[a:b].tobytes(), first[a:b].tobytes()) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if b > a]
                yield pd.DataFrame(found, columns=["block", "part", "hashes", "train", "first"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), np.uint64)
        unique, where, at = np.unique(h, return_index=True, return_inverse=True)
        c = np.bincount(at, np.frombuffer(b"".join(pdf["train"]), np.int32), minlength=len(unique)).astype(np.int64)
        first = np.frombuffer(b"".join(pdf["first"]), np.uint16)[where]
        by_first = np.stack([np.bincount(first, c, minlength=IDS), np.bincount(first, c > 0, minlength=IDS)]).astype(np.int64)
        seen = np.flatnonzero(by_first[0])
        ends = np.cumsum([len(x) // 8 for x in pdf["hashes"]])[:-1]
        once = np.arange(len(pdf)) == 0
        firsts = np.full(len(pdf), None, dtype=object)
        firsts[0] = np.vstack([seen, by_first[:, seen]]).tobytes()
        return pd.DataFrame(
            {
                "block": pdf["block"].to_numpy(), "part": key[0], "counts": [squeezed(x) for x in np.split(c[at], ends)],
                "n": once * int(c.sum()), "v": once * int((c > 0).sum()), "once": once * int((c == 1).sum()), "twice": once * int((c == 2).sum()), "firsts": firsts,
            }
        )

    cuts = table.select("block", "hashes", "train", "rank", "n_ids", "ids").mapInPandas(cut, "block string, part int, hashes binary, train binary, first binary")
    return cuts.groupBy("part").applyInPandas(add, "block string, part int, counts binary, n long, v long, once long, twice long, firsts binary")


class Known:
    """The training words as they are: by first subword how many tokens and different words, and what is taken off each word's count for words not seen."""

    def __init__(self, counts: DataFrame, subwords: Subwords):
        def by_id(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((2, IDS), dtype=np.int64)
            for pdf in batches:
                for data in pdf["firsts"]:
                    ids, n, v = np.frombuffer(data, np.int64).reshape(3, -1)
                    total[:, ids] += [n, v]
            ids = np.flatnonzero(total[0])
            yield pd.DataFrame({"id": ids, "n": total[0, ids], "v": total[1, ids]})

        rows = counts.where("firsts is not null").select("firsts").mapInPandas(by_id, "id long, n long, v long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # IDS rows at most
        first = subwords.flat[subwords.first[[r.id for r in rows]]] if rows else np.zeros(0, np.int64)
        self.tokens = np.bincount(first, [r.n for r in rows], minlength=SUBWORDS)
        self.words = np.bincount(first, [r.v for r in rows], minlength=SUBWORDS)
        once, twice = (x or 0 for x in counts.agg(F.sum("once"), F.sum("twice")).first())
        self.off = min(0.9, max(0.1, once / max(1, once + 2 * twice)))  # absolute discounting's usual estimate

    def chances(self, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms, given a word's first subword, of its chance as a known word and of the chance that is left for spelling."""
        tokens = np.maximum(self.tokens[first], 1)
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(c - self.off, 0) / tokens), np.log(np.where(self.tokens[first] > 0, self.off * self.words[first] / tokens, 1.0))


class Subwords:
    """The commonest ids of the tokenizer, single bytes among them: first an end and those that begin a word, from branch
    `border` of the tree's first level on the others, both in order of their bytes.

    Any other id is spelled out in single bytes, so every text has subwords.
    """

    def __init__(self, counts: np.ndarray, tokenizer: str):
        enc = encoder(tokenizer)
        own = {enc.decode_single_token_bytes(i): i for i in range(enc.n_vocab) if counts[i] or i < 256}
        single = [i for b, i in own.items() if len(b) == 1]
        rest = sorted((i for b, i in own.items() if len(b) > 1), key=lambda i: (-counts[i], i))[: SUBWORDS - BRANCH**2 - len(single)]
        chosen = sorted(single + rest, key=enc.decode_single_token_bytes)
        starts = [i for i in chosen if enc.decode_single_token_bytes(i)[:1] == b" "]
        self.border = -(-(1 + len(starts)) // BRANCH**2)
        new = {i: k for k, i in enumerate(starts, 1)}
        new |= {i: k for k, i in enumerate((i for i in chosen if i not in new), self.border * BRANCH**2)}
        pieces = [[new[i]] if i in new else [new[own[bytes([b])]] for b in enc.decode_single_token_bytes(i)] if i < enc.n_vocab else [END] for i in range(IDS)]
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.flat = np.array([x for p in pieces for x in p], dtype=np.int32)
        self.turned = np.full(SUBWORDS + 1, BRANCH * BRANCH - 1, dtype=np.int64)  # groups of subwords by how they end
        by_end = sorted(new, key=lambda i: enc.decode_single_token_bytes(i)[::-1])
        self.turned[[new[i] for i in by_end]] = np.arange(len(by_end)) * (BRANCH * BRANCH - 1) // max(1, len(by_end))

    def spread(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of words whose ids lie one after another, and how many each has."""
        k = self.length[ids]
        total = np.concatenate(([0], np.cumsum(k)))
        out = self.flat[np.repeat(self.first[ids] - total[:-1], k) + np.arange(total[-1])]
        edge = np.concatenate(([0], np.cumsum(n)))
        return out, total[edge[1:]] - total[edge[:-1]]

    def texts(self, ids: bytes, n_ids: bytes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Subwords of a run of words, given as numbers in a block's list, and how many each has."""
        flat, n = self.spread(restored(ids, np.uint16), restored(n_ids, np.int32).astype(np.int64))
        k = n[words]
        return flat[np.repeat((np.cumsum(n) - n)[words] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))], k


def per_document(k: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """How many subwords each document has, from how many each word has."""
    total, edge = np.concatenate(([0], np.cumsum(k))), np.concatenate(([0], np.cumsum(n_words)))
    return total[edge[1:]] - total[edge[:-1]]


def windows(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, document) of all windows: each subword and the end are a target once; -1 where there is none.

    A document starts with CONTEXT + 1 start marks; window k has the inputs from STEP * k on,
    and its targets follow all but the first CONTEXT of these.
    """
    many = -(-(n + 1) // STEP)
    size = many * STEP + CONTEXT + 1
    offset = np.concatenate(([0], np.cumsum(size)))
    line = np.full(offset[-1], END, dtype=np.int32)
    line[(offset[:-1, None] + np.arange(CONTEXT + 1)).ravel()] = START
    within = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    line[np.repeat(offset[:-1] + CONTEXT + 1, n) + within] = flat
    doc = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    start = offset[doc] + k * STEP
    x = line[start[:, None] + np.arange(WINDOW)]
    y = line[start[:, None] + CONTEXT + 1 + np.arange(STEP)]
    y[k[:, None] * STEP + np.arange(STEP) > n[doc][:, None]] = -1
    return x, y, doc


class Pairs:
    """Counts of neighbouring subwords in all training documents: what follows each subword down to the tree's second
    level, and the third level after each of BRANCH ** 2 groups of subwords by their endings."""

    def __init__(self) -> None:
        self.follow = np.zeros((SUBWORDS + 1) * BRANCH**2, dtype=np.int64)
        self.leaf = np.zeros(BRANCH**2 * SUBWORDS, dtype=np.int64)

    def add(self, subwords: Subwords, flat: np.ndarray, n: np.ndarray) -> None:
        ends = np.cumsum(n)
        after = np.insert(flat, ends, END).astype(np.int64)  # each document with its end
        before = np.full(len(after), START, dtype=np.int64)
        before[1:] = after[:-1]
        before[np.concatenate(([0], ends[:-1] + np.arange(1, len(n))))[: len(n)]] = START
        self.follow += np.bincount(before * BRANCH**2 + after // BRANCH, minlength=len(self.follow))
        self.leaf += np.bincount(subwords.turned[before] * SUBWORDS + after, minlength=len(self.leaf))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of the branches' chances, each smoothed by the chance without its condition."""
        follow = self.follow.reshape(-1, BRANCH, BRANCH).astype(np.float64)
        leaf = self.leaf.reshape(-1, BRANCH * BRANCH, BRANCH).astype(np.float64)

        def smooth(c: np.ndarray, prior: np.ndarray, weight: float) -> np.ndarray:
            return np.log((c + weight * prior) / (c.sum(axis=-1, keepdims=True) + weight)).astype(np.float32)

        def prior(c: np.ndarray) -> np.ndarray:
            return (c + 0.5) / (c + 0.5).sum(axis=-1, keepdims=True)

        one, two, three = prior(follow.sum(axis=(0, 2))), prior(follow.sum(axis=0)), prior(leaf.sum(axis=0))
        return smooth(follow.sum(axis=2), one, PRIOR), smooth(follow, two, PRIOR).reshape(-1, BRANCH), smooth(leaf, three, PRIOR).reshape(-1, BRANCH)


#: What a position may see: itself and earlier positions.
_SEEN = (np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None]).astype(np.float32)
_ONES = np.ones(WINDOW, np.float32)
#: Bound of exponents.
FAR = np.float32(60)
_SHAPES = {"embed": (SUBWORDS + 1, SIZE), "place": (WINDOW, SIZE), "q": (SIZE, SIZE), "k": (SIZE, SIZE), "v": (SIZE, SIZE), "o": (SIZE, SIZE), "u": (SIZE, 2 * BRANCH)}


class Attention:
    """One layer of masked self-attention over a tree of three levels of BRANCH choices, the last of which follows the counts alone."""

    def __init__(self, bias: tuple[np.ndarray, np.ndarray, np.ndarray], turned: np.ndarray, border: int, weights: dict[str, np.ndarray] | None = None, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.turned, self.border = bias, turned, border
        scale = {"embed": 0.3, "place": 0.1, "u": 0.02}
        self.w = weights or {k: (rng.standard_normal(s) * scale.get(k, 1 / math.sqrt(s[0]))).astype(np.float32) for k, s in _SHAPES.items()}

    def pack(self) -> bytes:
        return b"".join(self.w[k].astype(np.float32).tobytes() for k in _SHAPES)

    @staticmethod
    def unpack(data: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for k, s in _SHAPES.items():
            out[k] = data[at : at + math.prod(s)].reshape(s).astype(np.float32)
            at += math.prod(s)
        return out

    def forward(self, x: np.ndarray, y: np.ndarray) -> tuple:
        """What the gradients need: the vectors of all steps, and each level's exponents, their sums and the targets' places.

        Exponents are kept within FAR, so no maximum has to be taken off them first; sums over
        short rows are products with a vector of ones, which is what makes them fast.
        """
        w = self.w
        e = np.take(w["embed"], x, axis=0)
        e += w["place"]
        r0 = e[:, CONTEXT:].reshape(-1, SIZE)
        q = (r0 @ (w["q"] / np.float32(math.sqrt(SIZE)))).reshape(len(x), STEP, SIZE)
        k, v = ((e.reshape(-1, SIZE) @ w[i]).reshape(e.shape) for i in ("k", "v"))
        a = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.clip(a, -FAR, FAR, out=a)
        np.exp(a, out=a)
        a *= _SEEN
        a /= (a.reshape(-1, WINDOW) @ _ONES).reshape(len(x), STEP, 1)
        o = a @ v
        z = o.reshape(-1, SIZE) @ w["o"]
        z += r0
        t = y.reshape(-1)
        known = np.maximum(t, 0)
        before = x[:, CONTEXT:].reshape(-1)
        at = np.arange(len(t)) * BRANCH
        levels = []
        for level, (row, branch) in enumerate(((before, known // BRANCH**2), (before * BRANCH + known // BRANCH**2, known // BRANCH % BRANCH))):
            p = z @ w["u"][:, level * BRANCH : (level + 1) * BRANCH]
            p += np.take(self.bias[level], row, axis=0)
            np.clip(p, -FAR, FAR, out=p)
            np.exp(p, out=p)
            levels.append((p, p @ _ONES[:BRANCH], at + branch))
        return e, q, k, v, a, o, z, levels, t, (self.turned[before] * BRANCH**2 + known // BRANCH) * BRANCH + known % BRANCH

    def scores(self, x: np.ndarray, y: np.ndarray, run: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Natural logarithms of each target's probability and of the probability that a word begins there; 0 where there is no target."""
        out, begins = np.zeros(y.size), np.zeros(y.size)
        for i in range(0, len(x), run):
            *_, levels, t, leaf = self.forward(x[i : i + run], y[i : i + run])
            (p, total, at), (p2, total2, at2) = levels
            score = np.log(p.reshape(-1)[at] / total) + np.log(p2.reshape(-1)[at2] / total2) + self.bias[2].reshape(-1)[leaf]
            score[t < 0] = 0
            own = slice(i * STEP, (i + run) * STEP)
            out[own] = score
            begins[own] = np.log((p[:, : self.border] @ _ONES[: self.border]) / total)
        return out, begins

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        e, q, k, v, a, o, z, levels, t, _ = self.forward(x, y)
        n = np.float32(max(1, (t >= 0).sum()))
        d = np.empty((len(t), 2 * BRANCH), np.float32)
        for level, (p, total, own) in enumerate(levels):
            p.reshape(-1)[own] -= total
            np.divide(p, (total * n)[:, None], out=d[:, level * BRANCH : (level + 1) * BRANCH])
        d[t < 0] = 0
        g = {"u": z.T @ d}
        dz = d @ w["u"].T
        g["o"] = o.reshape(-1, SIZE).T @ dz
        do = (dz @ w["o"].T).reshape(o.shape)
        da = do @ np.ascontiguousarray(v.transpose(0, 2, 1))
        dkv = np.empty((*v.shape[:2], 2 * SIZE), np.float32)
        np.matmul(a.transpose(0, 2, 1), do, out=dkv[:, :, SIZE:])
        da -= ((o * do).reshape(-1, SIZE) @ _ONES[:SIZE]).reshape(len(x), STEP, 1)  # the sum over da * a
        da *= a
        dq = (da @ k).reshape(-1, SIZE)
        np.matmul(da.transpose(0, 2, 1), q, out=dkv[:, :, :SIZE])
        dkv = dkv.reshape(-1, 2 * SIZE)
        r0 = e[:, CONTEXT:].reshape(-1, SIZE)
        scale = np.float32(1 / math.sqrt(SIZE))
        g["q"] = r0.T @ dq * scale
        both = e.reshape(-1, SIZE).T @ dkv
        g["k"], g["v"] = both[:, :SIZE], both[:, SIZE:]
        de = (dkv @ np.concatenate((w["k"], w["v"]), axis=1).T).reshape(e.shape)
        dz += dq @ (w["q"] * scale).T
        de[:, CONTEXT:] += dz.reshape(o.shape)
        g["place"] = (_ONES[:1].repeat(len(x)) @ de.reshape(len(x), -1)).reshape(WINDOW, SIZE)
        cells = (x.reshape(-1, 1).astype(np.int64) * SIZE + np.arange(SIZE)).reshape(-1)  # one count over all columns
        g["embed"] = np.bincount(cells, de.reshape(-1), (SUBWORDS + 1) * SIZE).astype(np.float32).reshape(-1, SIZE)
        return g

    def train(self, runs: Iterable[tuple[np.ndarray, np.ndarray]], expected: int, rate: float, seed: int) -> int:
        """Adam over the windows of all runs, some runs' in random order at a time; LEAST_STEPS batches at least. Returns how many windows there were.

        The rate falls as if `expected` windows came.
        """
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.w.items()} for _ in range(2))
        step, seen, steps = 0, 0, max(LEAST_STEPS, -(-expected // BATCH))
        for x, y in gathered(runs, LEAST_STEPS * BATCH):
            again = False
            while not again or step < LEAST_STEPS:
                order = rng.permutation(len(x))
                for at in range(0, len(x), BATCH):
                    if again and step >= LEAST_STEPS:
                        break
                    step += 1
                    some = order[at : at + BATCH]
                    now = rate * (1 - 0.9 * min(1.0, step / steps))
                    # both means are kept undivided by their warming up, which is part of the rate and of the least divisor
                    level = math.sqrt(1 - 0.99**step)
                    own, least = np.float32(now * level / (1 - 0.9**step)), np.float32(1e-8 * level)
                    for k, g in self.gradients(x[some], y[some]).items():
                        m[k] *= np.float32(0.9)
                        m[k] += np.float32(0.1) * g
                        g *= g
                        g *= np.float32(0.01)
                        v[k] *= np.float32(0.99)
                        v[k] += g
                        np.sqrt(v[k], out=g)
                        g += least
                        np.divide(m[k], g, out=g)
                        g *= own
                        self.w[k] -= g
                again = True
            seen += len(x)
        return seen


def gathered(runs: Iterable[tuple[np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of runs together, `least` or more but for the last."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for run in runs:
        kept.append(run)
        if sum(len(x) for x, _ in kept) >= least:
            yield tuple(np.concatenate(z) for z in zip(*kept, strict=True))
            kept = []
    if sum(len(x) for x, _ in kept):
        yield tuple(np.concatenate(z) for z in zip(*kept, strict=True))


def documents(flat: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, inputs, targets, document) of the windows of some documents at a time."""
    edge = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(edge, edge[at] + PIECE // 4, side="right")) - 1)
        yield at, to, *windows(flat[edge[at] : edge[to]], n[at:to])
        at = to


def stretches(flat: np.ndarray, n: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of every ROUNDS-th window of each document, others in each round, so that the rounds cover all."""
    xs, ys = [np.zeros((0, WINDOW), np.int32)], [np.zeros((0, STEP), np.int32)]
    for at, _, x, y, doc in documents(flat, n):
        keep = (np.arange(len(doc)) - np.searchsorted(doc, doc) + doc + at) % ROUNDS == turn
        xs.append(x[keep])
        ys.append(y[keep])
    return np.concatenate(xs), np.concatenate(ys)


def training(r, subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of a block's training documents, and how many each document has."""
    n_words, train = np.frombuffer(r.n_words, np.int32).astype(np.int64), ~np.frombuffer(r.held, bool)
    flat, k = subwords.texts(r.ids, r.n_ids, restored(r.words, np.uint32)[np.repeat(train, n_words)])
    return flat, per_document(k, n_words[train])


def fit(table: DataFrame, tokenizer: str) -> tuple[Subwords, Attention]:
    """Train on the stored blocks: counts of all training documents, then ROUNDS of training on all their windows, whose results are averaged."""
    spark = table.sparkSession

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(IDS, dtype=np.int64)
        for pdf in batches:
            for data in pdf["seen"]:
                ids, n = np.frombuffer(data, np.uint32).reshape(2, -1)
                total[ids] += n
        ids = np.flatnonzero(total)
        yield pd.DataFrame({"id": ids.astype(np.int64), "n": total[ids]})

    counts = np.zeros(IDS, dtype=np.int64)
    for r in table.select("seen").mapInPandas(seen, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # IDS rows at most
        counts[r.id] = r.n
    subwords = Subwords(counts, tokenizer)
    sent = spark.sparkContext.broadcast(subwords)
    texts = table.select("ids", "n_ids", "words", "n_words", "held")

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, windows_ = Pairs(), 0
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                flat, n = training(r, sent.value)
                own.add(sent.value, flat, n)
                windows_ += int((-(-(n + 1) // STEP)).sum())
        both = np.array_split(np.concatenate([own.follow, own.leaf]), GROUPS)
        yield pd.DataFrame({"piece": np.arange(GROUPS), "counts": [squeezed(x) for x in both], "part": TaskContext.get().partitionId(), "n": windows_})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [key[0]], "counts": [squeezed(sum(restored(x, np.int64) for x in pdf["counts"]))]})

    counted_pairs, _ = stored(texts.mapInPandas(pairs, "piece long, counts binary, part int, n long"))
    rows = counted_pairs.groupBy("piece").applyInPandas(add, "piece long, counts binary").collect()  # GROUPS rows
    known = Pairs()
    if rows:
        both = np.concatenate([restored(r.counts, np.int64) for r in sorted(rows)])
        known.follow, known.leaf = both[: len(known.follow)], both[len(known.follow) :]
    model = Attention(known.tables(), subwords.turned, subwords.border)
    sent = spark.sparkContext.broadcast((subwords, model.bias))
    sizes = {r.part: r.n for r in counted_pairs.where("piece = 0").select("part", "n").collect()}  # a number for each partition

    def mean(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * r.n for r in pdf.itertuples(index=False))
        return pd.DataFrame({"n": [pdf["n"].sum()], "weights": [total.tobytes()]})

    for turn in range(ROUNDS):
        now = spark.sparkContext.broadcast(model.pack())

        def train(batches: Iterator[pd.DataFrame], turn: int = turn, now=now) -> Iterator[pd.DataFrame]:
            sub, bias = sent.value
            own = Attention(bias, sub.turned, sub.border, Attention.unpack(np.frombuffer(now.value, np.float32)))
            part = TaskContext.get().partitionId()
            found = (stretches(*training(r, sub), turn) for pdf in batches for r in pdf.itertuples(index=False))
            if n := own.train(found, sizes.get(part, 0) // ROUNDS, RATE / (1 + turn), turn):
                yield pd.DataFrame({"part": [part % GROUPS], "n": [n], "weights": [own.pack()]})

        done = texts.mapInPandas(train, "part int, n long, weights binary").groupBy("part").applyInPandas(mean, "n long, weights binary").collect()  # GROUPS rows at most
        if done:
            total = sum(np.frombuffer(r.weights, np.float64) for r in sorted(done, key=lambda r: (r.n, r.weights))) / sum(r.n for r in done)
            model = Attention(model.bias, subwords.turned, subwords.border, Attention.unpack(total))
    return subwords, model


def mixed(model: Attention, words: np.ndarray, n_words: np.ndarray, k: np.ndarray, flat: np.ndarray, known: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(natural logarithm of each document's probability, its subwords with the end).

    The attention model gives a word's first subword, as one that begins a word. The word itself
    is then a known one, or spelled by the attention model: its other subwords, and that a word
    begins after it. So the chances of all words and the end add up to one in every context.
    """
    n = per_document(k, n_words)
    total = np.zeros(len(n))
    word_edge = np.concatenate(([0], np.cumsum(n_words)))
    for at, to, x, y, _ in documents(flat, n):
        own = slice(word_edge[at], word_edge[to])
        keep = y.reshape(-1) >= 0
        score, begins = (s[keep] for s in model.scores(x, y))
        ends = word_edge[at + 1 : to + 1] - word_edge[at]  # a document's end follows its words
        each = np.insert(k[own], ends, 1)
        first = np.cumsum(each) - each
        event = score[first] - begins[first]
        is_word = np.ones(len(each), dtype=bool)
        is_word[ends + np.arange(to - at)] = False
        spelled_rest = (np.add.reduceat(score, first) - score[first])[is_word] + begins[(first + each)[is_word]]
        event[is_word] += np.logaddexp(known[words[own]], left[words[own]] + spelled_rest)
        total[at:to] = np.bincount(np.repeat(np.arange(to - at), n_words[at:to] + 1), event, minlength=to - at)
    return total, n + 1


def scored(table: DataFrame, counts: DataFrame, tokens: int, different: int, ends: int, subwords: Subwords, model: Attention, known_words: Known) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score, n_subwords of every document."""
    scale = math.log10(tokens + 0.1 * (different + 1))
    end = math.log10(ends + 0.1)
    sent = table.sparkSession.sparkContext.broadcast((subwords, model.bias, model.pack(), known_words))

    def look(key: tuple, own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        sub, bias, weights, list_ = sent.value
        net = Attention(bias, sub.turned, sub.border, Attention.unpack(np.frombuffer(weights, np.float32)))
        r = own.iloc[0]
        by_hash = np.concatenate([restored(c, np.int64) for c in found.sort_values("part")["counts"]]) if len(found) else np.zeros(0, np.int64)
        c = np.empty_like(by_hash)
        c[restored(r["rank"], np.uint32)] = by_hash
        words, n = restored(r["words"], np.uint32), np.frombuffer(r["n_words"], np.int32).astype(np.int64)
        doc = np.repeat(np.arange(len(n)), n)
        base = np.bincount(doc, np.log10(c + 0.1)[words], minlength=len(n)) + end - (n + 1) * scale
        known = np.bincount(doc, c[words] > 0, minlength=len(n)).astype(np.int64) + (ends > 0)
        n_ids = restored(r["n_ids"], np.int32).astype(np.int64)
        first = sub.flat[sub.first[restored(r["ids"], np.uint16)[np.cumsum(n_ids) - n_ids]]]
        flat, k = sub.texts(r["ids"], r["n_ids"], words)
        score, subwords_ = mixed(net, words, n, k, flat, *list_.chances(c, first))
        ids = pd.array(np.frombuffer(r["doc_ids"], np.int64), dtype="Int64")
        ids[~np.frombuffer(r["named"], bool)] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(r["held"], bool), "n_tokens": n + 1, "n_known": known, "base_score": base, "score": score / math.log(10), "n_subwords": subwords_})

    left = table.select("block", "doc_ids", "named", "held", "n_words", "words", "rank", "n_ids", "ids")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_subwords long"
    return left.groupBy("block").cogroup(counts.select("block", "part", "counts").groupBy("block")).applyInPandas(look, schema)


def score(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every row of docs as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_subwords.

    Rows whose crc32(doc_id as text) mod 10 is 0 are held out; counts and model learn from the
    others. Words are told apart by 64-bit hashes. The model scores the sequence of words (A-Z
    in lower case, one space between them) as subwords and an end. A null text is empty and has
    the end only; a null doc_id counts as an empty id and stays null; repeated rows all count.
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    table, _ = stored(blocks(docs.select("doc_id", "text", held.alias("held_out")), tokenizer))
    total = table.agg(F.sum("n_unique"), F.sum("n_train")).first()
    ends = total[1] or 0
    counts, _ = stored(counted(table, total[0] or 0))
    sums = counts.agg(F.sum("n"), F.sum("v")).first()
    tokens, different = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    subwords, model = fit(table, tokenizer)
    out = scored(table, counts, tokens, different, ends, subwords, model, Known(counts, subwords))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_subwords")


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
