import random
from collections import defaultdict

import pandas as pd

from rolecall.llm.packing import Bins, op10_packing, pack, pack_shard

from .conftest import prose


def check(rows, words, capacity):
    """Every piece placed, nothing overlaps, no conflicts; rows: (shard, bin, offset, size, doc, source, cluster)."""
    total = defaultdict(int)
    by_bin = defaultdict(list)
    for shard, bin_no, offset, size, doc, source, cluster in rows:
        total[doc] += size
        by_bin[shard, bin_no].append((offset, size, source, cluster))
    assert total == words
    for held in by_bin.values():
        held.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:], strict=False)) and held[0][0] == 0
        assert held[-1][0] + held[-1][1] <= capacity
        sources = [h[2] for h in held if h[2] is not None]
        assert len(sources) == len(set(sources)) and len({h[3] for h in held}) == len(held)


def test_constraints_hold(make_docs):
    draw = random.Random(3)
    texts = {i: prose(i % 90, draw.choice([1, 5, 20, 60, 100, 250])) if i % 9 else prose(5, 30) for i in range(200)}
    source = {i: None if i % 11 == 0 else f"s{min(i % 7, 3)}" for i in texts}
    docs = make_docs([(i, t, "en", source[i]) for i, t in texts.items()])
    got = pack(docs, capacity=100, shard_rows=60).collect()
    assert len({r.shard for r in got}) > 1
    rows = [(r.shard, r.bin, r.offset, r.size, r.doc_id, source[r.doc_id], texts[r.doc_id]) for r in got]
    # two pieces of one text have one source; without a source they are of one cluster all the same
    check(rows, {i: len(t.split()) for i, t in texts.items()}, 100)


def tightest(pieces, capacity):
    """Best fit by trying every bin."""
    bins = []
    for size, source, cluster in pieces:
        fits = [b for b in bins if b["room"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        chosen = min(fits, key=lambda b: b["room"], default=None)
        if chosen is None:
            bins.append(chosen := {"room": capacity, "sources": set(), "clusters": set()})
        chosen["room"] -= size
        chosen["sources"].add(source)
        chosen["clusters"].add(cluster)
    return sorted(b["room"] for b in bins)


def test_successor_search_takes_the_tightest_bin():
    for seed in range(30):
        draw = random.Random(seed)
        bins, placed, want = Bins(50, 4), [], []
        for _ in range(60):
            size, source, cluster = draw.randint(1, 50), draw.randrange(4), draw.randrange(12)
            room = {b: r for b, r in enumerate(bins.room)}
            fits = [r for b, r in room.items() if r >= size and not bins.sources[b] >> source & 1 and not bins.clusters[b] >> cluster & 1]
            chosen, _ = bins.place(size, source, 1 << cluster)
            placed.append(room.get(chosen, 50))
            want.append(min(fits, default=50))
        assert placed == want


def test_without_conflicts_it_is_plain_best_fit():
    draw = random.Random(1)
    sizes = sorted((draw.randint(1, 40) for _ in range(80)), reverse=True)
    frame = pd.DataFrame({"_key": range(80), "piece": 0, "size": sizes, "source": None, "cluster": range(80)})
    got = pack_shard(frame, 50)
    rooms = sorted(50 - got.groupby("bin")["size"].sum())
    assert rooms == tightest([(s, i, i) for i, s in enumerate(sizes)], 50)


def test_odd_rows(odd_docs):
    got = pack(odd_docs, capacity=64)
    assert got.filter("doc_id in (3, 4, 5)").count() == 0
    assert got.filter("doc_id = 7").agg({"size": "sum"}).first()[0] == 30_000
    copies = got.filter("(doc_id < 3 or doc_id is null) and piece = 0").select("shard", "bin")
    assert copies.count() == copies.distinct().count() == 4
    assert pack(odd_docs.limit(0)).count() == 0


def test_near_copies_never_share_a_bin(make_docs):
    texts = {}
    for i in range(12):
        for j in range(9):  # one changed word each: two of them share 136 of 156 shingles
            words = prose(i, 150).split()
            words[8 * j + 5] = f"changed{j}"
            texts[100 * i + j] = " ".join(words)
    docs = make_docs([(i, t, "en", f"s{i}") for i, t in texts.items()])
    got = pack(docs, capacity=1500, shard_rows=5000).collect()
    held = defaultdict(list)
    for r in got:
        held[r.shard, r.bin].append(r.doc_id // 100)
    assert all(len(x) == len(set(x)) for x in held.values()) and max(map(len, held.values())) > 3
    plain = defaultdict(list)
    for r in pack(docs, capacity=1500, shard_rows=5000, near=False).collect():
        plain[r.shard, r.bin].append(r.doc_id // 100)
    assert any(len(x) != len(set(x)) for x in plain.values())  # equal texts alone would let them meet


def test_the_query_on_odd_rows(spark, odd_docs, sf):
    got = op10_packing(spark, sf.write("documents", odd_docs)).collect()
    words = sum(len((r.text or "").split()) for r in odd_docs.collect())
    assert sum(r.size for r in got) == words
    assert op10_packing(spark, _empty(sf, odd_docs)).count() == 0


def _empty(sf, docs):
    docs.limit(0).write.parquet(f"{sf}/none/documents.parquet")
    return f"{sf}/none"
