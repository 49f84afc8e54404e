"""Near copies by exact similarity: SimHash links and MinHash bands propose pairs, the Jaccard of five-word shingles decides.

Pairs come first from the SimHash index in Gray order (`simhash_gray`: three-word shingles, RADIUS bits): sets of one fingerprint are
proposed with the least of them, and for each link that spans a component of fingerprints the least sets of its two ends. That is as many pairs as
there are sets and fingerprints. At a similarity of 0.8 about 10 of 64 bits differ, so MinHash bands propose what SimHash cannot reach.

A text is the set of its runs of `k` words. Each set gets BANDS keys, each made of ROWS independent MinHash values, so two sets of
similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS: 0.99998 at 0.8, and more above. Sets that share a key form a bucket;
buckets of the same members are one. A pair becomes a link only if it was verified.

A bucket is not compared all with all. Its head is the member that meets most others over all buckets (the common original of a cloud
of edited copies), and every member is verified against the head, which is read once for a few hundred of them. Members that are then in the
head's component are settled with it. Any other member x fails the head, so too little of x lies inside the head: a set y that
is no smaller than the head can reach the bound with x only if the two also share shingles outside the head, and it is known how
many. So members are dealt anew by (head, shingle outside it), over the first of these in hash order that a pair with enough in
common cannot avoid (prefix filter); smaller sets that this rule does not cover form one group more. Edits made independently share
no such shingle and fall apart; groups whose members are one component are done. After ROUNDS such rounds the pairs of different
components that still share a group are verified one by one. So inside a bucket no pair at or above the bound that would join two components is missed.

Keys, ids and counts move, and texts only of sets that share a bucket, once for each head they meet. What can outgrow the input is the last step: texts alike
by less than the bound that also share outside every head they met, as many pairs as such a group has.

Defined results: null and empty texts are one (empty) set; a text of fewer than k words is one shingle; rows with equal doc_id and text
are one row; the row of the smallest doc_id (null last) stays, the least text hash among equal ones; an empty table gives an empty
result; all columns are kept. Sets and shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import simhash_gray
from tideline.llm.common import components, only, slices, stage, text_of, texts, width
from tideline.llm.simhash_gray import shingle_hashes

K, BANDS, ROWS = 5, 28, 5
#: Words of a shingle and differing bits of the SimHash links.
WORDS, RADIUS = 3, 3
#: Rounds of heads before what is left is compared pair by pair; members verified in one go against a head.
ROUNDS, STAR = 2, 256
#: Least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
CHUNK = 2048
_draw = np.random.default_rng(20)
FACTORS = _draw.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
OFFSETS = _draw.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)


def shingles(text: str, k: int = K) -> np.ndarray:
    return np.unique(shingle_hashes(text, k))


def band_keys(found: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of a set of shingle hashes."""
    least = np.full(len(FACTORS), ~np.uint64(0))
    for at in range(0, len(found), CHUNK):
        np.minimum(least, (FACTORS * found[None, at : at + CHUNK] + OFFSETS).min(axis=1), out=least)
    return [signed(xxhash.xxh64_intdigest(row.tobytes(), band)) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def inside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the sorted a are in the sorted b."""
    if not len(b):
        return np.zeros(len(a), bool)
    at = np.searchsorted(b, a)
    return b[np.minimum(at, len(b) - 1)] == a


def short_of(both: int, sizes: int) -> int:
    """How many more common members two sets of that total size need for LEAST, beyond the `both` they have; 0 or less: they are alike."""
    top, bottom = LEAST
    return max(0, -(((top + bottom) * both - top * sizes) // (top + bottom)))


def _mixed(head: int, found: np.ndarray) -> np.ndarray:
    """Keys of (head, shingle)."""
    h = (found ^ np.uint64(head & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, set_id, n, fp, bands) of every row; fp is its SimHash fingerprint."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        only()
        for b in slices(batches):
            ids, sizes, fps, bands = [], [], [], []
            for t in texts(b):
                found = shingles(t)
                ids.append(signed(xxhash.xxh64_intdigest(found.tobytes())))
                sizes.append(len(found))
                fps.append(simhash_gray.fingerprint(shingle_hashes(t, WORDS)))
                bands.append(band_keys(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                                             ["doc_id", "text_hash", "set_id", "n", "fp", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, set_id long, n long, fp long, bands array<long>")


def hashed_alike(found: DataFrame) -> DataFrame:
    """(head, id) of sets to verify, from the SimHash links of `found` (set_id, fp): see above."""
    sets = stage(found.select("set_id", "fp").distinct(), "hashed")
    first = stage(sets.groupBy("fp").agg(F.min("set_id").alias("head")), "fps")
    ends = lambda c: first.select(F.col("fp").alias(c), F.col("head").alias(f"set_{c}"))
    same = sets.join(first, "fp").select("head", F.col("set_id").alias("id"))
    near = simhash_gray.links(first, RADIUS).join(ends("a"), "a").join(ends("b"), "b").select(F.least("set_a", "set_b").alias("head"), F.greatest("set_a", "set_b").alias("id"))
    return stage(same.unionByName(near).where("head <> id").distinct(), "hashed_alike")


def _key(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def held_texts(sets: DataFrame, needed: DataFrame, docs: DataFrame) -> DataFrame:
    """(set_id, text) of the sets in `needed` (set_id), from the row that stays of each."""
    first = sets.join(needed, "set_id").select("set_id", _key("first.doc_id").alias("_key"), F.col("first.text_hash").alias("_text"))
    rows = docs.select(_key("doc_id").alias("_key"), F.xxhash64("text").alias("_text"), text_of().alias("text"))
    return stage(rows.join(first, ["_key", "_text"]).dropDuplicates(["set_id"]).select("set_id", "text"), "compared")


def headed(members: DataFrame) -> DataFrame:
    """(head, id) of each member but the head of the groups in members (key, id, mass); groups of the same members count once."""
    groups = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.max(F.struct("mass", "id"))["id"].alias("head"))
    once = groups.where("size > 1").groupBy("size", "x", "y").agg(F.min(F.struct("key", "head")).alias("one")).select("one.*")
    return members.join(once, "key").where("id <> head").select("head", "id").distinct()


def verified(pairs: DataFrame, held: DataFrame, sizes: DataFrame, more: bool) -> DataFrame:
    """(head, id, linked, keys, near, small) of pairs (head, id). With `more`, keys are those of (head, shingle) by which unlinked members
    have to meet; near: an unlinked member that a set smaller than the head may reach without such a shingle; small: a set smaller than the head."""
    spark = pairs.sparkSession
    pairs = stage(pairs.join(sizes.select(F.col("set_id").alias("id"), "n"), "id"), "proposed")
    stars = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low")).withColumn("parts", F.ceil(F.col("c") / STAR).cast("int"))
    stars = stage(stars.drop("c"), "stars")
    text = held.select(F.col("set_id").alias("id"), "text")
    body = pairs.join(stars, "head").select("head", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(0).cast("long").alias("low"), "id", F.lit(1).alias("body"))
    top = stars.select("head", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "low", F.col("head").alias("id"), F.lit(0).alias("body"))
    rows = top.unionByName(body).join(text, "id").repartition(width(spark), "head", "part").sortWithinPartitions("head", "part", "body")
    names = ["head", "id", "linked", "keys", "near", "small"]

    def run(batches):
        base, low = np.empty(0, np.uint64), 0
        for batch in slices(batches, 100):
            out = []
            for head, at_most, x, is_body, t in zip(*(batch.column(c).to_pylist() for c in ("head", "low", "id", "body", "text")), strict=True):
                own = shingles(t)
                if not is_body:
                    base, low = own, min(at_most, len(own))
                    continue
                common = inside(own, base)
                both = int(common.sum())
                linked = short_of(both, len(own) + len(base)) <= 0
                if more:
                    # what is common outside the head with any member, by the smallest of them; 1 at least, or the rule does not hold
                    least = short_of(both, len(own) + low)
                    apart = own[~common]
                    keys = _mixed(head, apart[: max(0, len(apart) - (1 if linked else max(1, least)) + 1)]).tolist()
                    out.append((head, x, linked, keys, not linked and least <= 0, len(own) < len(base)))
                else:
                    out.append((head, x, linked, [], False, False))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return stage(rows.select("head", "low", "id", "body", "text").mapInArrow(run, "head long, id long, linked boolean, keys array<long>, near boolean, small boolean"), "alike")


def classed(rows: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    return rows.join(label.select(F.col("node").alias(column), F.col("label").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))


def labelled(docs: DataFrame) -> DataFrame:
    """(set_id, first, label) of each distinct set; `first` is its row that stays and equal labels are one group of near copies."""
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    found = stage(marks(docs), "marks")
    sets = stage(found.groupBy("set_id").agg(F.min(rank).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands")), "sets")
    keys = sets.select(F.col("set_id").alias("id"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stage(keys.join(shared, "key"), "buckets")
    mass = stage(members.groupBy("id").agg(F.sum("size").alias("mass")), "mass")
    hashed = hashed_alike(found)
    needed = mass.select("id").unionByName(hashed.select("id")).unionByName(hashed.select(F.col("head").alias("id"))).distinct()
    held = held_texts(sets, needed.select(F.col("id").alias("set_id")), docs)
    links = verified(hashed, held, sets, False).where("linked").select(F.col("head").alias("a"), F.col("id").alias("b"))
    members = members.select("key", "id").join(mass, "id")
    for turn in range(ROUNDS):
        seen = verified(headed(members), held, sets, True)
        new = seen.where("linked").select(F.col("head").alias("a"), F.col("id").alias("b"))
        links = links.unionByName(new)
        label = components(links)
        seen = stage(classed(classed(seen.drop("linked"), label, "id", "class"), label, "head", "to"), "classed")
        alive = seen.where("class <> to").groupBy("head").agg(F.bool_or("near").alias("some_near"))
        left = seen.join(alive, "head")
        rest = F.when(F.col("some_near") & (F.col("near") | F.col("small")), F.array(F.xxhash64("head", F.lit(turn)))).otherwise(F.array().cast("array<long>"))
        dealt = left.select("id", "class", F.explode(F.concat("keys", rest)).alias("key"))
        open_ = dealt.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
        members = stage(dealt.join(open_, "key").join(mass, "id").distinct(), "regrouped")
    once = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    once = once.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key")
    left = stage(members.join(once, "key").select("key", "id", "class"), "left")
    other = left.select("key", F.col("id").alias("y"), F.col("class").alias("cy"))
    pairs = left.join(other, "key").where("id < y and class <> cy").select(F.col("id").alias("head"), F.col("y").alias("id")).distinct()
    last = verified(pairs, held, sets, False).where("linked").select(F.col("head").alias("a"), F.col("id").alias("b"))
    label = components(links.unionByName(last)).withColumnRenamed("node", "set_id")
    return sets.join(label, "set_id", "left").select("set_id", "first", F.coalesce("label", "set_id").alias("label"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies."""
    kept = labelled(docs).groupBy("label").agg(F.min("first").alias("kept"))
    kept = kept.select(_key("kept.doc_id").alias("_near_key"), F.col("kept.text_hash").alias("_near_text"))
    rows = docs.withColumns({"_near_key": _key("doc_id"), "_near_text": F.xxhash64("text")})
    one = rows.join(kept, ["_near_key", "_near_text"], "left_semi").dropDuplicates(["_near_key", "_near_text"])
    return one.select(*docs.columns)
