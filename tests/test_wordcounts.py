"""Counting words and prefixes in chunks, and the layout and the plans of the index made of them."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from linkloom.checks import registry
from linkloom.checks.ingest import new_store
from linkloom.operators import blockmax, fulltext, wordcounts
from linkloom.plans import index as index_plan
from linkloom.schema import INDEXED_FIELDS
from linkloom.sources.tables import Ranges
from tests.helpers import table

WORDS = ["spark", "sparkle", "spar", "cafe", "étude", "data", "x", "internationalization", "internationalisation", "中文", "𝒳a", "0day", "zz"]


def random_rows(n, seed, per_block=5):
    """Rows ``(id, length, block, tokens by field)`` sorted by block and id; some ids are there with several lengths."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        fields = {f: " ".join(rng.choices(WORDS, k=rng.choice([0, 1, 4]))) for f in INDEXED_FIELDS}
        fields["title"] = fields["title"] or "x" * (1 + i % 20)
        length = sum(len(t.split()) for t in fields.values())
        rows.append((f"id{i // 2 if i % 4 == 1 else i}", length, i // per_block, fields))
    return sorted(rows, key=lambda r: (r[2], r[0]))


def unpacked(packed):
    """Rows by range."""
    by_range = defaultdict(list)
    for batch in packed:
        for n in batch.column("range").to_pylist():
            by_range[n].append(batch)
    return {n: [tuple(r.values()) for b in wordcounts.unpacked(iter(batches)) for r in b.to_pylist()] for n, batches in by_range.items()}


def in_their_ranges(found, cuts, block_at):
    for n, rows in found.items():
        keys = [(r[0], r[block_at]) for r in rows]
        assert n == 0 or min(keys) >= cuts[n - 1]
        assert n == len(cuts) or max(keys) < cuts[n]


@pytest.mark.parametrize("chunk", [1, 9, 60, 10_000])
@pytest.mark.parametrize("cuts", [[], [("cafe", 3), ("spar", 0), ("spark", 2), ("spark", 7), ("sq", 0), ("é", 1), ("中", 0)]])
def test_counts_do_not_depend_on_chunks(monkeypatch, chunk, cuts):
    monkeypatch.setattr(wordcounts, "CHUNK_TOKENS", chunk)
    rows = random_rows(60, 1)
    want, prefixes = Counter(), defaultdict(Counter)
    sizes = defaultdict(int)
    for n, (i, length, block, fields) in enumerate(rows):
        sizes[block, i] = max(sizes[block, i], length)
        for f, tokens in fields.items():
            for w in tokens.split():
                want[w, i, f, length, block, n] += 1
                prefixes[block, i].update(w[:k] for k in range(1, min(len(w), wordcounts.PREFIX_CHARS) + 1))
    base = {"id": [r[0] for r in rows], "length": pa.array([r[1] for r in rows], pa.int32()), "block": pa.array([r[2] for r in rows], pa.int32())}
    given = pa.table(base | {f: [r[3][f] or None for r in rows] for f in INDEXED_FIELDS})
    found = unpacked(wordcounts.count_words(cuts)(iter(given.to_batches(max_chunksize=7))))
    in_their_ranges(found, cuts, 5)
    assert Counter(r for part in found.values() for r in part) == Counter((w, i, f, tf, length, block) for (w, i, f, length, block, _), tf in want.items())

    texts = pa.table(base | {"text": [" ".join(t for t in r[3].values() if t) for r in rows]})
    found = unpacked(wordcounts.count_prefixes(cuts)(iter(texts.to_batches(max_chunksize=7))))
    in_their_ranges(found, cuts, 1)
    per_block = defaultdict(list)
    for key, counts in prefixes.items():
        for prefix, freq in counts.items():
            per_block[prefix, key[0]].append((freq, sizes[key]))
    assert sorted(r for part in found.values() for r in part) == sorted(
        (*key, len(c), max(f for f, _ in c), min(n for _, n in c)) for key, c in per_block.items()
    )


def test_unpacked_rows_are_sorted_runs(monkeypatch):
    monkeypatch.setattr(wordcounts, "CHUNK_TOKENS", 20)
    rows = random_rows(80, 2)
    texts = pa.table({"block": pa.array([r[2] for r in rows], pa.int32()), "id": [r[0] for r in rows], "length": pa.array([r[1] for r in rows], pa.int32()), "text": [" ".join(t for t in r[3].values() if t) for r in rows]})
    packed = list(wordcounts.count_prefixes([])(iter(texts.to_batches())))
    assert len(packed) > 3
    keys = [(r["prefix"], r["block"]) for b in wordcounts.unpacked(iter(packed)) for r in b.to_pylist()]
    assert keys == sorted(keys) and len(keys) == len(set(keys))


def test_nothing_gives_nothing():
    assert not list(wordcounts.count_words([])(iter([]))) and not list(wordcounts.count_prefixes([("a", 1)])(iter([])))
    assert not list(wordcounts.unpacked(iter([])))


ROWS = [
    {"url": f"https://e.org/{i}", "title": random.Random(i).choice(WORDS), "summary": " ".join(random.Random(i).choices(WORDS, k=i % 40)), "notes": None}
    for i in range(300)
]


def test_a_range_holds_sorted_rows_and_no_other_does(spark, monkeypatch):
    """A file of the index was sorted by folder only, so no row group could be left out for a term."""
    monkeypatch.setattr(blockmax, "MIN_RANGE_TOKENS", 500)
    store = new_store(spark)
    store.commit("rows", {"bookmarks": table(spark, *ROWS)})
    index_plan.build_index(store, "index", 8)
    for name, key in (("postings", "term"), ("prefix_blocks", "prefix")):
        version = store.snapshot().layout[name]["0"]
        ends, rows = defaultdict(list), 0
        for file in Path(f"{store.root}/{name}/v={version}/bucket=0").rglob("*.parquet"):
            found = pq.ParquetFile(file).read(columns=[key, "block"])
            keys = list(zip(found[key].to_pylist(), found["block"].to_pylist()))
            assert keys == sorted(keys)
            ends[file.parent.name].append((keys[0], keys[-1]))
            rows += len(keys)
        assert rows == store.read(name).count()
        for parts in ends.values():
            assert all(before[1] < after[0] for before, after in zip(sorted(parts), sorted(parts)[1:]))
        assert max(len(parts) for parts in ends.values()) > 1 or len(ends) > 3


def test_texts_are_cut_into_words_once_and_counted_once(spark, monkeypatch):
    """Words were cut out three times more for the lengths, and everything was counted twice to sample its ranges."""
    monkeypatch.setattr(blockmax, "MIN_RANGE_TOKENS", 500)
    store, seen = new_store(spark), {}
    store.commit("rows", {"bookmarks": table(spark, *ROWS)})
    commit = store.commit

    def watched(batch_id, changes, touched=None):
        seen.update(changes)
        return commit(batch_id, changes, touched)

    monkeypatch.setattr(store, "commit", watched)
    index_plan.build_index(store, "index", 8)
    for name, rows in seen.items():
        laid = isinstance(rows, Ranges)
        plan = (rows.rows if laid else rows)._jdf.queryExecution().executedPlan().toString()
        assert "regexp" not in plan and laid == (name in ("postings", "prefix_blocks"))
        assert "rangepartitioning" not in plan


def test_lead_is_one_ascii_letter_or_digit(spark):
    terms = [w + "x" for w in map(chr, [*range(1, 0x250), 0x2460, 0xFF11, 0x1D7CF])] + ["", None]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    plain = F.when(F.left("term", F.lit(1)).rlike("^[a-z0-9]$"), F.left("term", F.lit(1))).otherwise("_")
    assert rows.filter(fulltext.lead(F.col("term")) != plain).isEmpty()


@pytest.mark.parametrize("name", ["hybrid_search_indexed", "index_version"])
def test_queries_sample_no_counted_rows(spark, monkeypatch, name):
    """Words and prefixes were counted once more for each shuffle by range that sampled them."""
    seen, plain = [], type(spark.range(1)).repartitionByRange

    def watched(rows, *args):
        seen.append(set(rows.columns))
        return plain(rows, *args)

    monkeypatch.setattr(blockmax, "MIN_RANGE_TOKENS", 10_000, raising=False)
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", watched)
    assert not registry.queries()[name](spark, "/root/testdata/sf0.001").isEmpty()
    assert seen and not any(columns & {"tf", "max_freq"} for columns in seen)
