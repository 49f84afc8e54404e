"""Toxicity scores of text restored by a noisy-channel decoder.

Disguised words ("1d10t", "s.t.u.p.i.d", "stuuupid", "l o s e r") are read as the output of a noisy channel: each observed
character is a step of a lattice with the letters it may stand for (itself, a look-alike, nothing for a separator, one letter
or two for a run of equal ones), each at a cost. Viterbi search over that lattice under a character trigram model finds the
likeliest spelling. The model is counted over the words of all documents (hashed counts, so its size is fixed and its counts
grow with the corpus). A run of single characters or of short groups of letters is one lattice in which a blank is nothing or a word
end, so "a l o s e r", "i d i o t s a r e" and "id iot" come apart where the model says. Then the restored words are scored with a lexicon learned from labelled rows: words and beginnings of words
at least twice as frequent in toxic as in clean documents where that cannot be chance (binomial tail times the number tried under
one half), whatever the share of toxic documents, and a logistic fit on a
document's hits.

Three passes read the documents and none shuffles a text: character counts and word counts are summed inside a task first, the
labelled sample (at most `train_rows` rows, by hash) is small enough to broadcast, and what reaches the driver are 2^20 counts
at most, the lexicon, and a histogram of the sample's hits.

Defined results: a null or empty text has no hits and the score of a text without any; rows with equal or null doc_id are
scored each on its own; labels that are neither 0 nor 1 are ignored, and a doc_id with both counts as toxic; without rows of both
labels to learn from the score is the share of toxic ones (0 if there are no labels); an empty table gives an empty result;
columns other than doc_id and text are kept by `score` and never read; its own are named `_tox_*` until the end.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import STORES, only, slices, stage, text_of, texts

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
BUCKETS = 1 << 20
#: Letters that look like these characters (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c"}
#: Characters that may stand between the letters of a word.
GAPS = ".-_*~'`^,/\\ "
LOOK_COST, GAP_COST, KEEP_RUN_COST, SAME_COST = 0.7, 0.3, 1.2, 0.0
EDGE = ".,;:!?\"'()[]{}<>…*#%&~"
_RUN = re.compile(r"(.)\1\1")
#: Marks of one kind, two or more in a row, at either end of a token: emphasis, not letters.
_TAIL = re.compile(r"^([^\w])\1+|([^\w])\2+$")
REMEMBERED = 80_000
#: Bytes of the store of tokens read (an entry takes its token and about ENTRY bytes), and what a token may be.
BYTES, ENTRY, HIT, SHORT = 30_000_000, 150, 1, 2
_SHORT = bytes(c >> 1 & 1 for c in range(256))
_HIT = re.compile(b"[\x01\x03]")
#: Letters of a token that may be part of a spaced word, and of such a word; parts of a word cut into groups.
PART, SPACED, GROUPS = 3, 24, 3
#: Cost of a blank that is no word end, between groups of letters (GAP_COST between single ones); tokens of two or three letters
#: that cost at most ORDINARY are words of their own.
BLANK_COST, ORDINARY = 6.0, 5.5


def slots(chars: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the n-grams that end at each place of rows of codes, last axis running along the word."""
    h = np.zeros(chars.shape, np.uint64)
    for k in range(n):
        back = np.zeros_like(chars) if k >= chars.shape[-1] else np.concatenate([np.zeros((*chars.shape[:-1], k), chars.dtype), chars[..., : chars.shape[-1] - k]], axis=-1)
        h = h * np.uint64(0x9E3779B97F4A7C15) + back.astype(np.uint64) + np.uint64(n)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.int64) % (BUCKETS // 4) + (n - 1) * (BUCKETS // 4)


def word_codes(words: list[str]) -> list[np.ndarray]:
    """Words as rows of codes between a start and an end mark (1 and 2), one array for each length."""
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    out = []
    for n, same in by_length.items():
        codes = np.frombuffer("".join(same).encode("utf-32-le"), np.uint32).reshape(-1, n)
        edge = lambda v, m=len(same): np.full((m, 1), v, np.uint32)
        out.append((same, np.concatenate([edge(1), codes, edge(2)], axis=1)))
    return out


def count_characters(docs: DataFrame) -> np.ndarray:
    """Hashed counts of the 1- to 3-grams of all alphabetic words of all documents, by their number of occurrences."""

    def run(batches):
        total, words = np.zeros(BUCKETS, np.float64), Counter()

        def fold():
            bare = Counter()
            for w, n in words.items():
                core = w.strip(EDGE)
                if core.isalpha():
                    bare[core] += n
            for same, codes in word_codes(list(bare)):
                times = np.array([bare[w] for w in same], np.float64)
                for n in (1, 2, 3):
                    at = slots(codes, n)[:, 1:]
                    total[:] += np.bincount(at.ravel(), np.repeat(times, at.shape[1]), BUCKETS)
            words.clear()

        for b in slices(batches):
            for t in texts(b):
                words.update(t.lower().split())
                if len(words) > REMEMBERED:
                    fold()
        fold()
        used = np.nonzero(total)[0]
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    counts = docs.select("text").mapInArrow(run, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.float32)
    out[counts["slot"].to_numpy(np.int64)] = counts["n"]
    return out


class Decoder:
    """Restores disguised words; one for each worker process."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.letters = float(counts[: BUCKETS // 4].sum()) + 1.0
        self.cost: dict[tuple[str, str], float] = {}

    def _cost(self, before: str, c: str) -> float:
        """Negative log probability of c after the two characters `before`, with interpolated back-off."""
        key = (before, c)
        if key not in self.cost:
            if len(self.cost) > 2 * REMEMBERED:
                self.cost.clear()
            codes = np.array([[ord(x) for x in before + c]], np.uint32)
            one, two, three = (float(self.counts[slots(codes, n)[0, -1]]) for n in (1, 2, 3))
            ctx1 = float(self.counts[slots(codes[:, :2], 1)[0, -1]]) if before[1] != "\x01" else self.letters
            ctx2 = float(self.counts[slots(codes[:, :2], 2)[0, -1]]) if before[0] != "\x00" else ctx1
            p = (one + 0.1) / self.letters
            p = (two + 5 * p) / (max(ctx1, two) + 5)
            p = (three + 5 * p) / (max(ctx2, three) + 5)
            self.cost[key] = -math.log(p)
        return self.cost[key]

    @staticmethod
    def lattice(token: str) -> list[list[tuple[str, float]]]:
        """Steps of (letters, cost), one for each run of equal observed characters."""
        steps = []
        for m in re.finditer(r"(.)\1*", token, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                step = [(c, SAME_COST if n == 1 else 0.1 * n), (c * 2, SAME_COST if n == 2 else 0.1 * n)] if n > 1 else [(c, SAME_COST)]
                if n > 2:
                    step.append((c * n, KEEP_RUN_COST * n))
            else:
                step = [(x * k, LOOK_COST * n) for x in LOOKS.get(c, "") for k in {1, min(n, 2)}]
                if c in GAPS or not step:
                    step.append(("", GAP_COST if c in GAPS else 4.0))
            steps.append(step)
        return steps

    def decode(self, token: str) -> str:
        return self.best(token)[1]

    def best(self, token: str) -> tuple[float, str]:
        """Cost and letters of the cheapest path, with its end mark."""
        paths = {"\x00\x01": (0.0, None)}  # last two characters: cost and chain of letters
        for step in self.lattice(token):
            ahead: dict[str, tuple] = {}
            for state, (cost, chain) in paths.items():
                for letters, extra in step:
                    s, total = state, cost + extra
                    for c in letters:
                        total += self._cost(s, c)
                        s = s[1] + c
                    if s not in ahead or total < ahead[s][0]:
                        ahead[s] = (total, (chain, letters) if letters else chain)
            paths = ahead
        total, chain = min(((cost + self._cost(s, "\x02"), chain) for s, (cost, chain) in paths.items()), key=lambda x: x[0])
        out = []
        while chain:
            chain, letters = chain
            out.append(letters)
        return total, "".join(reversed(out))

    def word_cost(self, word: str) -> float:
        """Cost of a piece of text as one word, as it stands or restored."""
        if not word.isalpha() or _RUN.search(word):
            return self.best(word)[0]
        marked = "\x00\x01" + word + "\x02"
        return sum(self._cost(marked[i : i + 2], marked[i + 2]) for i in range(len(word) + 1))


def disguised(token: str) -> bool:
    """A token worth decoding: letters with look-alikes or separators among them, or a letter three times running."""
    letters = sum(map(str.isalpha, token))
    if letters == len(token):
        return bool(_RUN.search(token))
    return letters >= 1 and 2 * (letters + sum(c in LOOKS for c in token)) > len(token) and not token[-1].isspace()


class Reader:
    """Turns a text into its restored words, remembering tokens it has seen (emptied when full)."""

    def __init__(self, counts: np.ndarray):
        self.decoder, self.known = Decoder(counts), {}
        self.parts, self.runs, self.costs = {}, {}, {}
        self.codes, self.found, self.held = {}, {}, 0
        self.lexicon, self.starts = None, set()

    def restore(self, token: str) -> str:
        core = token.strip(EDGE)
        if not core.isalpha():
            token = _TAIL.sub("", token.rstrip(EDGE) if token[0] in LOOKS else core)
            core = token.strip(EDGE)
        if not core or (core.isalpha() and not _RUN.search(core)):
            return core
        for seen in (core, token):
            if disguised(seen):
                return self.decoder.decode(seen)
        return core

    def words(self, text: str) -> list[str]:
        tokens = text.lower().split()
        if len(self.parts) > REMEMBERED // 4:
            self.parts = {}
        parts = self.parts
        short = []
        for i, w in enumerate(tokens):
            if len(w) <= PART + 1:
                if w not in parts:
                    parts[w] = self.part(w)
                if parts[w]:
                    short.append(i)
        if len(short) > 1:
            tokens = self._joined(tokens, short)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        for w in tokens:
            if w not in known:
                known[w] = self.restore(w)
        return [known[w] for w in tokens]

    def part(self, token: str) -> str:
        """What a token adds to a word spaced out: one character, or two or three letters that are no common word; else nothing."""
        if len(token) == 1 or (len(token) == 2 and token[1] in GAPS):
            return token[0]
        core = token.rstrip(EDGE)
        if len(core) == 1 and (core.isalpha() or core in LOOKS):
            return core
        return core if core.isalpha() and len(core) <= PART and self.decoder.word_cost(core) > ORDINARY else ""

    def hits(self, texts_: list[str], lexicon: dict[str, float]) -> list[list[tuple[str, float]]]:
        """For each text (restored word, weight) of each word that the lexicon knows, by itself or by how it begins.

        Each distinct token is read once: what it is for a text is a code of two bits (HIT, SHORT: may be part of a spaced word), so a text is
        one string of codes and only tokens with a code are looked at again."""
        tokens = [t.lower().split() for t in texts_]
        self.note(set().union(*tokens), lexicon)
        out = []
        for words in tokens:
            codes = bytes(map(self.codes.__getitem__, words))
            if codes.translate(_SHORT).find(b"\x01\x01") >= 0:
                words = self._joined(words, [i for i, c in enumerate(codes) if c & SHORT])
                self.note(set(words), lexicon)
                codes = bytes(map(self.codes.__getitem__, words))
            out.append([self.found[words[m.start()]] for m in _HIT.finditer(codes)] if codes.translate(None, b"\x00\x02") else [])
        if self.held > BYTES:
            self.codes, self.found, self.parts, self.held = {}, {}, {}, 0
        return out

    def note(self, tokens: set[str], lexicon: dict[str, float]) -> None:
        if lexicon is not self.lexicon:
            self.lexicon, self.starts = lexicon, {u[:4] for u in lexicon if u.endswith("*")}  # a longer beginning has a shorter one
        new = tokens.difference(self.codes)
        codes, starts = dict.fromkeys(new, 0), self.starts
        for w in new:
            if len(w) <= PART + 1:
                if w not in self.parts:
                    self.parts[w] = self.part(w)
                if self.parts[w]:
                    codes[w] = SHORT
            word = w.strip(EDGE)
            if not word.isalpha() or _RUN.search(word):
                word = self.restore(w)
            if word[:4] in starts or word in lexicon:
                weight = max((lexicon.get(u, 0.0) for u in forms(word)), default=0.0)
                if weight:
                    self.found[w] = (word, weight)
                    codes[w] |= HIT
        self.codes.update(codes)
        self.held += sum(map(len, new)) + ENTRY * len(new)

    def _joined(self, tokens: list[str], short: list[int]) -> list[str]:
        """Runs of two or more parts in a row become the words of their cheapest reading."""
        out, at, k = [], 0, 0
        while k < len(short):
            n = 1
            while k + n < len(short) and short[k + n] == short[k] + n:
                n += 1
            if n > 1:
                run = tuple(tokens[short[k] : short[k] + n])
                if len(self.runs) > REMEMBERED // 4:
                    self.runs = {}
                if n > SPACED:
                    read = self.segment(run)
                else:
                    read = self.runs.get(run)
                    if read is None:
                        read = self.runs[run] = self.pair(run) if n == 2 else self.segment(run)
                out += tokens[at : short[k]]
                out += read
                at = short[k] + n
            k += n
        return out + tokens[at:]

    def pair(self, run: tuple[str, ...]) -> list[str]:
        """segment() of two parts, as one word or as two."""
        a, b = (self.parts[w] if w in self.parts else self.part(w) for w in run)
        if (a + b).isalpha() or disguised(a + b):
            blank = GAP_COST if len(a) == len(b) == 1 else BLANK_COST
            if self.cost_of(a + b) + blank <= self.cost_of(a) + self.cost_of(b):
                return [a + b]
        return list(run)

    def segment(self, run: tuple[str, ...]) -> list[str]:
        """Cheapest reading of a run of parts: Viterbi over the lattice in which a blank is nothing or a word end."""
        parts = [self.parts[w] if w in self.parts else self.part(w) for w in run]
        best: list[tuple[float, int]] = [(0.0, 0), *[(math.inf, 0)] * len(parts)]
        for i in range(len(parts)):
            piece, state, cost, plain = "", "\x00\x01", best[i][0], True
            blanks = 0.0
            for j in range(i, len(parts)):
                if piece:
                    if len(piece) + len(parts[j]) > SPACED or (j - i >= GROUPS and len(piece) + len(parts[j]) > j - i + 1):
                        break
                    blanks += GAP_COST if len(parts[j - 1]) == len(parts[j]) == 1 else BLANK_COST
                piece += parts[j]
                plain = plain and parts[j].isalpha() and not (len(piece) > 2 and _RUN.search(piece))
                if plain:
                    more, end = self.going_on(state, parts[j])
                    cost, state = cost + more, (state + parts[j])[-2:]
                    total = cost + blanks + end
                elif j == i or piece.isalpha() or disguised(piece):
                    total = best[i][0] + blanks + self.cost_of(piece)
                else:
                    continue
                if total < best[j + 1][0]:
                    best[j + 1] = (total, i)
        out, j = [], len(parts)
        while j:
            i = best[j][1]
            out.append(run[i] if j - i == 1 else "".join(parts[i:j]))
            j = i
        return out[::-1]

    def going_on(self, state: str, part: str) -> tuple[float, float]:
        """Cost of the letters of a part after two characters, and of a word end then."""
        key = (state, part)
        if key not in self.costs:
            marked = state + part + "\x02"
            steps = [self.decoder._cost(marked[i : i + 2], marked[i + 2]) for i in range(len(part) + 1)]
            self.costs[key] = (sum(steps[:-1]), steps[-1])
        return self.costs[key]

    def cost_of(self, piece: str) -> float:
        if len(self.costs) > REMEMBERED // 4:
            self.costs = {}
        if piece not in self.costs:
            self.costs[piece] = self.decoder.word_cost(piece)
        return self.costs[piece]


def forms(word: str) -> list[str]:
    """What the lexicon may know of a word: itself and its beginnings of 4 to 6 letters."""
    return [word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) > n)] if word else []


_readers: dict[str, Reader] = {}
STORES["toxicity"] = _readers.clear


def reader(name: str, counts: np.ndarray) -> Reader:
    if name not in _readers:
        only()
        _readers[name] = Reader(counts)
    return _readers[name]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(toxic, text) of at most `train_rows` labelled documents outside the held-out third, by hash of doc_id."""
    usable = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")


def learn(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model: character counts, lexicon {word: weight} and logistic coefficients."""
    spark = docs.sparkSession
    counts = count_characters(docs)
    shared, name = spark.sparkContext.broadcast(counts), uuid.uuid4().hex
    rows = stage(sample(docs, labels, train_rows), "labelled")
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = {"counts": shared, "name": name, "lexicon": {}, "fit": None, "base": size.get(1, 0) / max(1, sum(size.values()))}
    if not (size.get(0) and size.get(1)):
        return model

    def seen(batches):
        found = (Counter(), Counter())
        for b in slices(batches):
            for toxic, t in zip(b.column("toxic").to_pylist(), texts(b), strict=True):
                found[toxic].update({u for w in set(reader(name, shared.value).words(t)) for u in forms(w)})
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([f[w] for w in words], pa.int64()) for f in found)], ["word", "clean", "bad"])

    tried = stage(rows.mapInArrow(seen, "word string, clean long, bad long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad")).where("clean + bad > 2"), "words")
    n_tried = tried.count()
    kept = tried.where(F.col("bad") * size[0] > 2 * F.col("clean") * size[1]).where("bad > 2").toPandas()  # a few words in a thousand of a bounded sample
    for word, clean, bad in kept.itertuples(index=False):
        if chance(bad, clean, model["base"]) * n_tried < 0.5:
            model["lexicon"][word] = math.log((bad + 0.5) / (size[1] + 1)) - math.log((clean + 0.5) / (size[0] + 1))
    lexicon = model["lexicon"]

    def hits(batches):
        tally = Counter()
        for b in slices(batches, 200):
            for toxic, found in zip(b.column("toxic").to_pylist(), reader(name, shared.value).hits(texts(b), lexicon), strict=True):
                tally[(toxic, *features(found))] += 1
        columns = zip(*((*k, n) for k, n in tally.items()), strict=True) if tally else [[]] * 4
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["toxic", "a", "b", "n"])

    table = rows.mapInArrow(hits, "toxic long, a double, b double, n long").groupBy("toxic", "a", "b").agg(F.sum("n").alias("n")).toPandas()  # at most `train_rows` rows
    model["fit"] = logistic(table[["a", "b"]].to_numpy(float), table["toxic"].to_numpy(float), table["n"].to_numpy(float))
    return model


def chance(bad: int, clean: int, base: float) -> float:
    """Chernoff bound of the chance that of bad + clean documents at least `bad` are toxic, if each is with probability `base`."""
    share = bad / (bad + clean)
    if share <= base:
        return 1.0
    return math.exp(-bad * math.log(share / base) - (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))


def features(hits: list[tuple[str, float]]) -> tuple[float, float]:
    """Summed weight of distinct hits (to a tenth, at most 40) and log of the number of hits."""
    return round(min(40.0, sum(dict(hits).values())), 1), round(math.log1p(len(hits)), 2)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, steps: int = 50) -> list[float]:
    """Coefficients (constant first) of a ridge logistic fit by damped Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    return beta.tolist()


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from `threshold` on)."""
    model = learn(docs, labels, train_rows)
    shared, name, lexicon, fit, base = model["counts"], model["name"], model["lexicon"], model["fit"], model["base"]

    def of(text: pd.Series) -> pd.Series:
        if fit is None:
            return pd.Series(np.full(len(text), base))
        at = reader(name, shared.value)
        z = [fit[0] + fit[1] * a + fit[2] * b for lo in range(0, len(text), 200) for a, b in map(features, at.hits(list(text[lo : lo + 200]), lexicon))]
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))))

    scored = docs.withColumn("_tox_score", F.pandas_udf(of, "double")(text_of()))
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    return scored.select(*keep, F.col("_tox_score").alias("score"), (F.col("_tox_score") >= threshold).cast("int").alias("predicted"))
