"""Operators on texts against brute force, with odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_rows import odd_rows

from tideline.llm import huffman_ids, license_automaton, mixing, packing, sharding, simhash_gray, tokens, toxicity, unit_dedup, winnowing
from tideline.session import scratch_path


def key(doc_id):
    return (doc_id is None, doc_id or 0)


# SimHash

def slow_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_simhash_components_match_all_pairs(spark, odd, radius):
    rows = simhash_gray.near_duplicates(odd, 3, radius).collect()
    texts = odd_rows()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in rows) == Counter((t[0], slow_fingerprint(t[1], 3)) for t in texts)
    fps = sorted({r["fp"] & (1 << 64) - 1 for r in rows})
    group = {f: {f} for f in fps}
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius and group[a] is not group[b]:
                both = group[a] | group[b]
                for f in both:
                    group[f] = both
    for r in rows:
        ids = [t[0] for t in texts if slow_fingerprint(t[1], 3) in group[r["fp"] & (1 << 64) - 1] and t[0] is not None]
        assert r["component_id"] == min(ids, default=None)


def test_simhash_links_in_dense_balls():
    rng = np.random.default_rng(0)
    centre = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([centre ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(60)]))
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if int(x[i] ^ x[j]).bit_count() <= 3}
    got = {(int(a), int(b)) for i, j in simhash_gray.linked(x, x, 3, True) for a, b in zip(i, j, strict=True)}
    assert got == want and len(want) > 1000


def test_keep_one_keeps_a_row_of_each_component(odd):
    kept = simhash_gray.keep_one(odd, 3, 3)
    assert kept.columns == odd.columns
    found = simhash_gray.near_duplicates(odd, 3, 3)
    assert kept.count() == found.select("label").distinct().count()
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found.collect()}


# repeated units

def test_repeats_are_cut_and_first_occurrences_stay(odd):
    rows = odd_rows()
    out = unit_dedup.remove_repeats(odd, 4)
    assert out.columns == [*odd.columns, "removed_spans", "removed_chars"]
    first = {}
    for doc_id, text, *_ in sorted(rows, key=lambda r: key(r[0])):
        for unit, lo, _ in unit_dedup.units(text or "", 4):
            rank = (*key(doc_id), lo)
            first.setdefault(unit, rank)
    seen = Counter()
    for r in out.collect():
        seen[(r["doc_id"], r["removed_spans"])] += 1
        text = next(t[1] for t in rows if t[0] == r["doc_id"] and (t[1] is None) == (r["text"] is None) and len(t[1] or "") == len(r["text"] or "") + r["removed_chars"])
        cut = {i for s in filter(None, r["removed_spans"].split(",")) for i in range(*map(int, s.split("-")))}
        assert (r["text"] or "") == "".join(c for i, c in enumerate(text or "") if i not in cut)
        if r["doc_id"] != 3:
            want = {i for unit, lo, hi in unit_dedup.units(text or "", 4) if first[unit] != (*key(r["doc_id"]), lo) for i in range(lo, hi)}
            assert cut == want
    assert sum(seen.values()) == len(rows)


def test_units_cover_the_text_without_loss():
    for _, text, *_ in odd_rows():
        assert "".join(m.group() for m in unit_dedup.SENTENCE.finditer(text or "")) == (text or "")


# toxicity

@pytest.fixture(scope="module")
def reader():
    counts = np.zeros(toxicity.BUCKETS, np.float32)
    for word, times in {"idiot": 50, "stupid": 50, "loser": 40, "the": 500, "letter": 90, "moon": 60}.items():
        for _, codes in toxicity.word_codes([word]):
            for n in (1, 2, 3):
                np.add.at(counts, toxicity.slots(codes, n)[:, 1:].ravel(), times)
    return toxicity.Reader(counts)


@pytest.mark.parametrize(("seen", "meant"), [("1d10t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("l o s e r", "loser"), ("5tup1d!!!", "stupid"), ("$tup1d", "stupid"), ("letter", "letter"), ("moooon", "moon"), ("the$$$", "the")])
def test_disguises_are_restored(reader, seen, meant):
    assert reader.words(f"the {seen} the")[1] == meant


def test_viterbi_finds_the_cheapest_path(reader):
    decoder = reader.decoder
    for token in ("1d10t", "l0s3rr", "s-t1p"):
        paths = [("", 0.0)]
        for step in decoder.lattice(token):
            paths = [(w + x, c + e) for w, c in paths for x, e in step]
        cost = lambda w: sum(decoder._cost(("\x00\x01" + w)[i : i + 2], (w + "\x02")[i]) for i in range(len(w) + 1))
        best = min(c + cost(w) for w, c in paths)
        got = decoder.decode(token)
        assert min(c for w, c in paths if w == got) + cost(got) == pytest.approx(best)


def test_scores_separate_held_out_rows(spark, odd, empty):
    rng = random.Random(5)
    bad = ["idiot", "stupid", "1d10t", "s.t.u.p.i.d"]
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "cloud", "stone"]) for _ in range(30)) + (" " + " ".join(rng.sample(bad, 2)) if i % 4 == 0 else ""), None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == 600 and all(r["predicted"] == (r["doc_id"] % 4 == 0) and 0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs, labels.limit(0)).where("predicted = 1 or score <> 0").count() == 0
    scored = toxicity.score(odd, labels)
    assert scored.count() == odd.count() and scored.where("score is null").count() == 0
    assert toxicity.score(empty, labels).count() == 0


# shards

@pytest.mark.parametrize("shards", [1, 3, 7, 40])
def test_shards_are_the_least_contiguous_cut(odd, shards):
    out = sharding.shard(odd, shards).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["shard"] < shards for r in out)
    for s in {r["shard"] for r in out}:
        mine = [r["slot"] for r in out if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))
    groups = defaultdict(int)
    where = {}
    hashes = {(r["doc_id"], r["text_crc32"]): r["_hash"] for r in sharding.sized(odd).collect()}
    for r in out:
        h = hashes[(r["doc_id"], r["text_crc32"])]
        groups[h] += r["size"]
        assert where.setdefault(h, r["shard"]) == r["shard"]
    load = Counter()
    for h, s in where.items():
        load[s] += groups[h]
    left, n, alone = sum(groups.values()), shards, []
    for h, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if n == 1 or size * n <= left:
            break
        alone.append(h)
        left, n = left - size, n - 1
    rest = [groups[h] for h in sorted(groups) if h not in alone]
    def fits(capacity):
        used, room = 1, capacity
        for size in rest:
            if size > room:
                used, room = used + 1, capacity
            room -= size
        return used <= n
    best = next(c for c in range(max(rest), sum(rest) + 1) if fits(c))
    assert max(load[s] for s in range(shards - n, shards)) == best


# mixing

def test_mix_meets_targets_and_caps(odd, empty):
    rows = mixing.mix(odd.withColumn("words", mixing.words()), "words").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["words"]) for r in rows) == Counter((t[0], count(t[1])) for t in odd_rows())
    sizes = Counter()
    for t in odd_rows():
        sizes[t[3]] += count(t[1])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (sum(sizes.values()) - sum(target.values())) / max(1, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target.update({s: 3 * sizes[s] for s in over})
        open_ -= over
    target.update({s: level * weight[s] for s in open_})
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 3
    again = mixing.mix(odd.repartition(5).withColumn("words", mixing.words()), "words").collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))
    assert mixing.mix(empty.withColumn("words", mixing.words()), "words").count() == 0


# license scan

def test_automaton_states_are_the_longest_runs():
    rng = random.Random(0)
    templates = [[bytes([97 + rng.randrange(3)]) for _ in range(12)] for _ in range(4)]
    automaton = license_automaton.SuffixAutomaton(templates)
    for _ in range(60):
        text, got, i = [bytes([97 + rng.randrange(4)]) for _ in range(15)], {}, 0
        while i < len(text):
            last = i
            for j, state, n in automaton.longest(text, i):
                got[j], last = (n, automaton.ends[state]), j
            i = max(last + 1, i + 1)
        for j in range(len(text)):
            best = (0, set())
            for n in range(1, j + 2):
                ends = {(t, k) for t, s in enumerate(templates) for k in range(n - 1, len(s)) if s[k - n + 1 : k + 1] == text[j - n + 1 : j + 1]}
                best = (n, ends) if ends else best
            assert got.get(j, (0, set())) == best


def test_license_phrases_and_spans(odd, empty):
    rows = {(r["doc_id"], r["n_words"]): r for r in license_automaton.scan(odd).collect()}
    for doc_id, text, *_ in odd_rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in license_automaton.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = rows[(doc_id, len(words))]
        assert r["n_base"] == len(places) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    scanner = license_automaton.Scanner()
    label, text = license_automaton.TEMPLATES[1]
    broken = text.split()
    broken[20:21] = ["some", "other", "words"]
    assert scanner.scan("before it " + " ".join(broken) + " after it")["labels"] == [label]
    assert scanner.scan("this software and that license for any purpose")["labels"] == []
    assert license_automaton.scan(empty).count() == 0


# winnowing

def test_winnowing_matches_its_definition(odd, empty):
    rng = random.Random(3)
    for _ in range(200):
        codes, k, w = winnowing.codes_of("".join(rng.choice("ab") for _ in range(rng.randrange(60)))), rng.randrange(1, 9), rng.randrange(1, 12)
        h = winnowing.run_hashes(codes, k).tolist()
        w = min(w, len(h))
        want = []
        for i in range(len(h) - w + 1 if w else 0):
            j = max(x for x in range(i, i + w) if h[x] == min(h[i : i + w]))
            want += [j] if want[-1:] != [j] else []
        assert winnowing.winnow(codes, k, w)[1].tolist() == want
    shared = "x" * 5 + "".join(rng.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.WINDOW - 1))
    a, b = (winnowing.winnow(winnowing.codes_of(p + shared + q))[0] for p, q in (("one text ", " ends"), ("some other start ", "")))
    assert len(np.intersect1d(a, b))
    rows = winnowing.edited_fingerprints(odd).collect()
    assert len(rows) == len(odd_rows())
    order = sorted({(r[0], r[1] or "") for r in odd_rows() if r[0] is not None and r[0] not in (3, 4)}, reverse=True)
    got = {(r["doc_id"], r["n_chars"]): r for r in rows}
    for (i, text), (_, after) in zip(order, order[1:], strict=False):
        if i in (20, 5):
            continue
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[(i, len(text))]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert winnowing.edited_fingerprints(empty).count() == 0


# tokens, files, packing

SPACES = ["", " ", "  ", "a  b", "a   b", " \n b", "\n  x", "a \nb  ", "x\t y", "it's don't  'll", "tr  ", "\x85 a", "a\x1c b", "q\n\n  \n r", "<|endoftext|> x"]


def test_remembered_pieces_give_the_library_s_ids():
    coder = tokens.encoder()
    texts = SPACES + [r[1] or "" for r in odd_rows()]
    want = [np.array(e.ids, "<u4").tobytes() for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == want and coder.encode(texts) == want


def test_files_hold_all_ids_in_order(spark, odd, empty):
    path = scratch_path(spark, "huffman-test")
    huffman_ids.write(odd, path)
    out = sorted(huffman_ids.read(spark, path).collect(), key=lambda r: r["start"])
    ids = {}
    for doc_id, text, *_ in odd_rows():
        raw = tokens.encoder().encode([text or ""])[0] + bytes(4)
        ids[(doc_id, zlib.crc32(raw))] = len(raw) // 4
    at = 0
    for r in out:
        assert r["start"] == at and ids[(r["doc_id"], r["ids_crc32"])] == r["n_tokens"]
        at += r["n_tokens"]
    assert len(out) == len(odd_rows()) and [key(r["doc_id"]) for r in out] == sorted(key(r["doc_id"]) for r in out)
    path = scratch_path(spark, "huffman-test")
    huffman_ids.write(empty, path)
    assert huffman_ids.read(spark, path).count() == 0


def test_code_is_optimal_limited_and_round_trips():
    rng = np.random.default_rng(0)
    for limit in (4, 9, 16):
        counts = (rng.pareto(0.6, 12 if limit == 4 else 300) * 10 + 1).astype(np.int64)
        bits = huffman_ids.code_lengths(counts, limit)
        assert bits.max() <= max(limit, int(len(counts) - 1).bit_length()) and (2.0 ** -bits).sum() == pytest.approx(1)
        code = huffman_ids.Code(np.arange(len(counts)) * 7, bits)
        blocks = [rng.choice(len(counts), n, p=counts / counts.sum()) * 7 for n in (1, 255, 256, 257, 5000)]
        packed = [(*code.pack(b), len(b)) for b in blocks]
        assert all((a == b).all() for a, b in zip(code.unpack(packed), blocks, strict=True))
    assert huffman_ids.code_lengths(np.array([9])).tolist() == [1]


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing_is_gapless_and_whole(odd, empty, capacity):
    out = packing.pack(odd, capacity).collect()
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = Counter()
    for doc_id, text, *_ in odd_rows():
        total[doc_id] += len(tokens.encoder().encode([text or ""])[0]) // 4 + 1
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["length"]
        assert r["length"] == capacity or r["piece"] == 0
    assert got == total and len(bins) <= 1.05 * sum(total.values()) / capacity + 1
    assert packing.pack(empty, capacity).count() == 0


def test_dominance_never_costs_a_bin():
    def least(items, capacity):
        items = sorted(items, reverse=True)
        best = [len(items)]
        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
                go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            go(i + 1, [*rooms, capacity - items[i]])
        go(0, [])
        return best[0]
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(8, 20)
        items = [rng.randint(1, capacity) for _ in range(rng.randint(3, 9))]
        left = Counter(items)
        fixed = packing.dominated(left, capacity)
        rest = list(left.elements())
        assert sum(n for _, n in fixed) + (least(rest, capacity) if rest else 0) == least(items, capacity)
