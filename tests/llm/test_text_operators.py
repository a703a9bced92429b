import hashlib
import itertools
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillbin.llm import ann, crf, decontaminate, langid, licences, lm, mixing, passages, pfor, simhash

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = "[^\x20\x09-\x0d]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


# ---------------------------------------------------------------- 1


def test_contamination_against_brute_force(spark, odd):
    items = [(1, "one two three four five six seven eight nine"), (2, "THE short ITEM"), (None, "plain words in a row"), (3, ""), (4, None), (10, "one two three four five six seven eight"), (5, "words and then some more all sorts of words")]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(20, "x one two three four five six seven eight! nine, y the-short item z one two three four five six seven eight", 0.1)], "doc_id long, text string, score double"))
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    bench = [(i, re.findall(WORD, (t or "").translate(LOWER))) for i, t in items if i is not None]
    want = []
    for d, t, _ in docs.collect():
        w = re.findall(WORD, (t or "").translate(LOWER))
        hit, found = set(), set()
        for i, b in bench:
            n = min(8, len(b))
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if b else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(i)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.contaminated for r in got)


def test_longest_matches_and_removal(spark):
    docs = spark.createDataFrame([(1, "zz a b c d e f g h i yy"), (2, "nothing"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "x a b c d e f g h i w")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, bench).collect()] == [(1, 7, 1, 1, 9)]
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, None}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 3 and decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark_add_up(spark, documents, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contamination(documents, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_VOCABULARY", 60)
    assert len(decontaminate.blocks_of(bench)) > 5
    assert sorted(map(tuple, decontaminate.contamination(documents, bench).collect())) == whole


# ---------------------------------------------------------------- 2


def test_passages_are_found_and_clean_documents_left(spark):
    rng = np.random.default_rng(0)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared, docs = words(60), []
    for i in range(12):
        docs.append((i, " ".join(words(150) + shared + words(80))))
    fuzzy = [w if k % 12 else "changed" for k, w in enumerate(shared)]
    docs += [(20, " ".join(words(40) + fuzzy + words(40))), (30, " ".join(words(200))), (31, " ".join(shared[:40] + words(100))), (40, " ".join(docs[3][1].split())), (50, "of " * 300), (51, "of " * 120 + " ".join(words(30))), (60, None), (61, ""), (None, docs[2][1])]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    seen = {r.doc_id for r in got} | {r.other_doc_id for r in got}
    assert seen == {*range(12), 20, 40, 50, 51}
    text = {d: (t or "").split() for d, t in docs}
    for r in got:
        a, b = text[r.doc_id][r.start : r.start + r.n_words], text[r.other_doc_id][r.other_start : r.other_start + r.n_words]
        assert r.n_words >= 50 and r.similarity >= 0.8 and (r.similarity < 1 or a == b)
    assert passages.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_with_a_fifth_of_the_words_changed(spark):
    rng = np.random.default_rng(5)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    docs, n = [], 40
    for i in range(n):
        shared, size = words(64), 64
        changed = set(range(4, size, 5)) if i % 2 else set(rng.choice(np.arange(1, size - 1), size // 5, replace=False).tolist())
        docs.append((2 * i, " ".join(words(100) + shared + words(30))))
        docs.append((2 * i + 1, " ".join(words(30) + [f"x{i}y{k}" if k in changed else w for k, w in enumerate(shared)] + words(100))))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.other_doc_id)) for r in got} == {frozenset((2 * i, 2 * i + 1)) for i in range(n)}


def test_every_exact_passage_is_covered(spark):
    """Texts put together from a few pieces, some of them said again and again: each word of an exact passage of 50 words is in some passage found."""
    rng = np.random.default_rng(7)
    pieces = [[f"p{rng.integers(0, 200)}" for _ in range(int(rng.integers(3, 40)))] for _ in range(25)] + [["na", "na", "batman"] * 30]
    docs = [(i, sum((pieces[k] for k in rng.integers(0, len(pieces), 14)), [])) for i in range(60)]
    got = passages.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    covered = {(r.doc_id, k) for r in got for k in range(r.start, r.start + r.n_words)} | {(r.other_doc_id, k) for r in got for k in range(r.other_start, r.other_start + r.n_words)}
    at: dict = {}
    for i, w in docs:
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), []).append((i, k))
    shared = [v for v in at.values() if len({i for i, _ in v}) > 1]
    missed = [[(i, k) for i, k in v if not all((i, k + j) in covered for j in range(50))] for v in shared]
    assert shared and all(len({i for i, _ in m}) <= 1 for m in missed)  # the representative's further places are not listed


def test_passages_whose_seeds_come_in_many_other_texts(spark):
    """Of the common seeds of two texts most have another representative than either; and a closer partner hides no other one."""
    rng = np.random.default_rng(11)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    docs, n, pieces = [], 30, [[] for _ in range(150)]
    for i in range(n):
        shared = words(64)
        docs.append((2 * i, " ".join(words(60) + shared + words(30))))
        docs.append((2 * i + 1, " ".join(words(30) + [f"x{i}y{k}" if k % 5 == 4 else w for k, w in enumerate(shared)] + words(60))))
        for k in range(0, 60, 5):
            for d in rng.choice(len(pieces), 12, replace=False).tolist():
                pieces[d] += words(3) + shared[k : k + 4]
    docs += [(1000 + d, " ".join(p)) for d, p in enumerate(pieces)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {frozenset((2 * i, 2 * i + 1)) for i in range(n)} <= {frozenset((r.doc_id, r.other_doc_id)) for r in got}

    docs, want = [], set()
    for i in range(30):
        shared = words(60)
        change = lambda ks: [f"x{i}y{k}{rng.integers(10**9)}" if k in ks else w for k, w in enumerate(shared)]  # noqa: B023, E731
        one, two = change({*range(5, 60, 11)}), change({*range(9, 60, 10)})  # either is near to the whole, not to the other
        docs += [(3 * i + k, " ".join(words(20) + x + words(20))) for k, x in enumerate((shared, one, two))]
        want |= {frozenset((3 * i, 3 * i + 1)), frozenset((3 * i, 3 * i + 2))}
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert want <= {frozenset((r.doc_id, r.other_doc_id)) for r in got}


def test_parts_that_are_aligned_add_up(spark, monkeypatch):
    rng = np.random.default_rng(13)
    shared = [[f"w{x}" for x in rng.integers(0, 10**9, 60)] for _ in range(6)]
    docs = [(i, " ".join(["own", str(i), *shared[i % 6], *shared[(i + 1) % 6]])) for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = []
    for parts in (1, 5):
        monkeypatch.setattr(passages, "PARTS", parts)
        rows.append(sorted(map(tuple, passages.repeated_passages(frame).collect())))
    assert rows[0] == rows[1] and len(rows[0]) >= 39 and len(set(rows[0])) == len(rows[0])


def test_odd_rows_have_no_passages(odd):
    assert {r.doc_id for r in passages.repeated_passages(odd).collect()} == set()


def test_chains_are_the_best_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        x, y = rng.integers(0, 60, n).tolist(), rng.integers(0, 60, n).tolist()
        best = 0.0
        for size in range(1, n + 1):
            for some in itertools.combinations(sorted(range(n), key=lambda i: (x[i], y[i])), size):
                steps = list(zip(some, some[1:], strict=False))
                if all(0 < x[b] - x[a] and 0 < y[b] - y[a] for a, b in steps):
                    best = max(best, len(some) - sum(0.01 * (x[b] - x[a] + y[b] - y[a]) for a, b in steps))
        got = passages.chains(x, y)
        score = max((len(c) - sum(0.01 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:], strict=False)) for c in got), default=1.0)
        assert score == pytest.approx(best)


def test_a_strong_chain_hides_no_later_one():
    first, later = list(range(0, 500, 8)), list(range(900, 960, 8))
    got = passages.chains(first + later, first + [v + 700 for v in later])
    assert sorted(map(len, got)) == [len(later), len(first)]


def test_chains_within_reach_by_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(2, 80))
        x, y = rng.integers(0, 300, n).tolist(), rng.integers(0, 300, n).tolist()
        score = [1.0] * n
        for i in sorted(range(n), key=x.__getitem__):
            near = [score[j] - 0.01 * (x[i] - x[j] + y[i] - y[j]) for j in range(n) if 0 < x[i] - x[j] <= 64 and 0 < y[i] - y[j] <= 64]
            score[i] = 1 + max(0.0, *near) if near else 1.0
        got = passages.chains(x, y)
        assert all(0 < x[b] - x[a] <= 64 and 0 < y[b] - y[a] <= 64 for c in got for a, b in zip(c, c[1:], strict=False))
        assert max((len(c) - sum(0.01 * (x[b] - x[a] + y[b] - y[a]) for a, b in zip(c, c[1:], strict=False)) for c in got), default=1.0) == pytest.approx(max(score))


def test_one_diagonal_is_aligned_as_any_chain():
    """A chain's first and last match on one diagonal, aligned as slices, and the same with a match between them, which takes the general way."""
    rng = np.random.default_rng(12)
    for _ in range(300):
        a = rng.integers(0, 2**32, int(rng.integers(70, 400))).astype(np.uint32)
        b = np.where(rng.random(len(a)) < rng.choice([0, 0.1, 0.2, 0.5]), rng.integers(0, 2**32, len(a)), a).astype(np.uint32)
        shift = int(rng.integers(0, 60))
        i, m, j = (np.sort(rng.choice(len(a) - shift - passages.K, 3, replace=False)) if len(a) - shift > passages.K + 3 else (0, 1, 2))
        b = np.concatenate([rng.integers(0, 2**32, shift).astype(np.uint32), b])
        ends, three = np.array([i, j]), np.array([i, m, j])
        assert passages.align(a, b, ends, ends + shift) == passages.align(a, b, three, three + shift)


# ---------------------------------------------------------------- 3


def test_neighbours_reach_their_recall(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.toPandas()
    v = np.array(rows.embedding.tolist(), np.float64)
    v /= np.sqrt((v * v).sum(1, keepdims=True))
    hit = total = 0
    got = {k: g for k, g in ann.neighbours(e).toPandas().groupby("query_id")}
    for n in np.flatnonzero(rows.vec_id % 50 == 0):
        s = v @ v[n]
        s[n] = -2
        want = rows.vec_id[np.lexsort((rows.vec_id, -s))[:5]].tolist()
        mine = got[rows.vec_id[n]].sort_values("rank")
        hit += len(set(want) & set(mine.vec_id))
        total += 5
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and mine.score.is_monotonic_decreasing
    assert hit / total >= 0.9


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [1e300, 1e300]), (50, [1.0, 0.0]), (10, [])]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 50), (0, 3, 1), (0, 4, 9), (50, 1, 0), (50, 2, 2), (50, 3, 1), (50, 4, 9)]
    assert ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_neighbours_of_many_parts_and_blocks(spark, monkeypatch):
    """Exact cosines of what is found, at two sizes, where blocks and their queries' parts are small."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    for n in (300, 1500):
        centres = rng.normal(size=(12, 8))
        v = centres[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, 8))
        v[7] = v[9] * 3.0  # a scaled copy
        got = ann.neighbours(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>"), every=5).collect()
        hits = 0
        for q in range(0, n, 5):
            own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r.vec_id for r in own}
            cos = (v * v[q]).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((v[q] * v[q]).sum()))
            assert all(r.score == cos[r.vec_id] for r in own) and own == sorted(own, key=lambda r: (-r.score, r.vec_id))
            cos[q] = -2
            hits += len({r.vec_id for r in own} & set(np.argsort(-cos, kind="stable")[:5].tolist()))
        assert hits >= 0.9 * n


# ---------------------------------------------------------------- 4


def test_licences(spark, odd, none):
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy of it. The above copyright notice and this permission notice shall be included. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.'
    rows = [(1, mit), (2, "x.\nReleased under the MIT License.\ny"), (3, "Licensed under CC BY-NC 4.0."), (4, "SPDX-License-Identifier: Apache-2.0"), (5, "Copyright 2020 Me. All rights reserved."), (6, "Ask for permission first."), (7, "Licensed under the Apache License, Version 2.0. Also under the GNU General Public License, version 3."), (8, None)]
    got = {r.doc_id: r for r in licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r.licences for k, r in got.items()} == {1: "MIT", 2: "MIT", 3: "CC-BY-NC", 4: "Apache-2.0", 5: "Proprietary", 6: "", 7: "Apache-2.0,GPL-3.0", 8: ""}
    assert got[1].sentences == "mit-grant,mit-notice,mit-as-is" and got[1].n_unclaimed == 0 and got[5].n_unclaimed == 1
    assert licences.licences(odd).count() == odd.count() and licences.licences(none).count() == 0


BSD = """Copyright (c) 2020, A. Maker

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT DAMAGES.
"""
CLAUSE_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
HEADER = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {}General Public License as
 * published by the Free Software Foundation, either version {} of
 * the License, or (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {}General Public License for more details.
 *
 * You should have received a copy of the GNU {}General Public License
 * along with this program.
"""
ISC = """ISC License

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software, to deal in the Software without restriction, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def test_wrapped_and_unwrapped_licences(spark):
    import textwrap
    from pathlib import Path

    header = lambda kind, version: HEADER.format(kind, version, kind, kind)
    cases = {
        "BSD-2-Clause": BSD.format(""), "BSD-3-Clause": BSD.format(CLAUSE_3), "GPL-3.0-or-later": header("", 3), "GPL-2.0-or-later": header("", 2), "AGPL-3.0-or-later": header("Affero ", 3),
        "LGPL-or-later": header("Lesser ", "2.1"), "ISC": ISC, "MIT": MIT, "Apache-2.0": APACHE, "MPL-2.0": MPL,
    }
    rows = []
    for name, text in cases.items():
        flat = "\n\n".join(" ".join(x.strip(" *#") for x in p.split("\n")) for p in re.split(r"\n[ *#]*\n", text))
        rows += [(name, text), (name, flat), (name, textwrap.fill(flat.replace("\n\n", " "), 43)), (name, text.replace("\n", "\r\n"))]
    whole = Path("/usr/share/common-licenses")
    for name, file in (("GPL-3.0", "GPL-3"), ("GPL-2.0", "GPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if (whole / file).exists():
            text = (whole / file).read_text(errors="replace")
            rows += [(name, text), (name, "\n\n".join(" ".join(p.split()) for p in text.split("\n\n")))]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.licences(docs).collect()}
    assert {k: got[k].licences.replace("Proprietary", "").strip(",") for k in got} == {k: name for k, (name, _) in enumerate(rows)}


# ---------------------------------------------------------------- 5


def slow_fingerprint(text, width):
    w = re.findall(SPACED, (text or "").translate(LOWER))
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def classes(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def test_simhash_against_brute_force(spark, odd, none, documents, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    fps = {i: slow_fingerprint(t, 4) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    linked = [(a, b) for a, b in itertools.combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in got.items()} == classes(fps, linked)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count() and {r.component_id for r in rows if r.fingerprint == "0" * 16} == {2}
    assert simhash.near_duplicates(none).count() == 0


def test_tiles_of_every_size_agree(spark, documents):
    small = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents, radius=9, tile=16).collect()}
    assert small == {r.doc_id: r.component_id for r in simhash.near_duplicates(documents, radius=9).collect()}


def test_forest_of_a_dense_group():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 3).astype(np.uint64)
    x = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for b in base]))
    a, b = simhash.tile_forest(x, None, 4)
    assert len(a) == len(x) - len(base) == len(set(a.tolist())) and set(b.tolist()) <= set(x.tolist())


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    texts = []
    for g in range(6):
        base = rng.choice(vocabulary, 120).tolist()
        for _ in range(14):  # more near copies than a round proposes, some of them near by a chain only
            own = list(base)
            for k in rng.choice(120, rng.integers(0, 6), replace=False):
                own[k] = "other"
            texts.append(" ".join(own))
            if rng.random() < 0.3:
                base = own
    texts = list(dict.fromkeys(texts))
    sets = [set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 14 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted(tuple(k for k in range(len(texts)) if find(k) == r) for r in {find(k) for k in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, tile in ((1, 8), (1, 1 << 17), (3, 16)):
        rows, classes = simhash.near_copies(docs, tile=tile, most=most)
        groups = rows.join(classes, "text_hash").groupBy("root").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
        assert sorted(tuple(r.ids) for r in groups.collect()) == want, (most, tile)


def test_deduplicate_keeps_one_of_each_group(spark, odd, none):
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
    near = [*words[:100], "other", *words[101:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (9, " ".join(words)), (4, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))), (None, " ".join(words))]
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [3, 4]
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert kept.filter("doc_id = 1").count() == 1 and simhash.deduplicate(none).count() == 0


def test_only_sizes_that_allow_the_similarity_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 4000
    sizes = np.sort(np.exp(rng.uniform(np.log(10), np.log(10**4), n)).astype(np.int64))
    fps, sketches = rng.integers(0, 2**63, n).astype(np.uint64), np.zeros((n, simhash.SKETCH // 16), np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(5)  # the next size
    cells, count = [0], np.bitwise_count
    with monkeypatch.context() as m:
        m.setattr(np, "bitwise_count", lambda x: cells.__setitem__(0, cells[0] + x.size) or count(x))
        i, j, _, _ = simhash.tile_pairs(fps, None, (sizes, sizes), (sketches, sketches), 2, 0.8)
    near = {(k, k + 1) for k in range(0, n, 2) if sizes[k] >= 0.8 * sizes[k + 1]}
    assert near <= {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)} and cells[0] < 0.12 * n * n

    texts = spark.createDataFrame([(k, int(x)) for k, x in enumerate([0, 0, *sizes[::10].tolist()])], "text_hash long, shingles long")
    at = {}
    rows = simhash._dealt_by_size(texts, 0.8, 16).collect()
    for r in rows:
        at.setdefault(r.text_hash, {})[r.pair] = r.side
    size = {r.text_hash: r.shingles for r in rows}
    assert size == {r.text_hash: r.shingles for r in texts.collect()} and len(rows) < 9 * len(size)
    for x, y in itertools.combinations(sorted(size), 2):
        if min(size[x], size[y]) >= 0.8 * max(size[x], size[y]):
            assert len(set(at[x]) & set(at[y])) >= 1


def test_near_copies_with_far_fingerprints(spark):
    rng, pairs = np.random.default_rng(2), []
    while len(pairs) < 3:
        base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
        near = list(base)
        for k in rng.choice(300, 6, replace=False):
            near[k] = f"z{k}"
        one, two = " ".join(base), " ".join(near)
        a, b = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (one, two))
        far = (simhash.fingerprint(one.encode(), 5) ^ simhash.fingerprint(two.encode(), 5)).bit_count() > 14
        if far and len(a & b) >= 0.8 * len(a | b):
            pairs += [(2 * len(pairs), one, two)]
    rows = [(k + j, t) for k, *both in pairs for j, t in enumerate(both)]
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [k for k, *_ in pairs]


# ---------------------------------------------------------------- 6


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 200, 50_000, 2**31, 2**32 - 1])
def test_segments_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.03] = 2**32 - 1
    seg = pfor.Segment(pfor.write_segment([1, None], [n // 2, n - n // 2], ids))
    assert np.array_equal(seg.ids(), ids) and np.array_equal(seg.ids(n // 3, n // 2), ids[n // 3 :][: n // 2])
    assert seg.doc_ids == [1, None]
    with pytest.raises(ValueError):
        pfor.Segment(b"x" * 100)


def test_tokens_against_the_library(spark, documents, texts, odd, none, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pfor._default_tokenizer())
    start = 0
    for r in pfor.token_output(documents).orderBy("doc_id").collect():
        ids = np.array([*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    rows = pfor.token_output(odd, path=str(tmp_path / "t"))
    assert rows.count() == odd.count() and rows.filter("n_tokens = 1").count() == 4
    back = pfor.read_token_files(spark, str(tmp_path / "t"), with_ids=True).filter("doc_id = 6").first()
    assert back.ids == [*tok.encode("wörter ohne sinn und verstand", add_special_tokens=False).ids, 2]
    assert pfor.token_output(none).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> hi", "İstanbul ΣΑΣ été x y \x1cfoo\x1dbar it's we'LL 12³ x\x00y ß ǅ ﬁ", "日本語 テスト", "á ́b", "x" * 500])
def test_odd_words_encode_as_the_library_does(text):
    from tokenizers import Tokenizer

    source = open(pfor._default_tokenizer(), encoding="utf-8").read()
    want = Tokenizer.from_str(source).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(pfor.encoder(source)(text.encode()), "<u4").tolist() == want


# ---------------------------------------------------------------- 7


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(10):
        sizes = rng.integers(1, 7, 4)
        first = np.concatenate([[0], np.cumsum(sizes)])
        score, trans = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
        good, pairs, z = crf.marginals(score, trans, first)
        want, pair, log = [], np.zeros((2, 2)), 0.0
        for a, b in itertools.pairwise(first):
            each = {y: np.exp(sum(score[a + i] for i in range(b - a) if y[i]) + sum(trans[y[i], y[i + 1]] for i in range(b - a - 1))) for y in itertools.product((0, 1), repeat=b - a)}
            total = sum(each.values())
            want += [sum(w for y, w in each.items() if y[i]) / total for i in range(b - a)]
            for y, w in each.items():
                for i in range(b - a - 1):
                    pair[y[i], y[i + 1]] += w / total
            log += np.log(total)
        assert np.allclose(good, want) and np.allclose(pairs, pair) and z == pytest.approx(log)


def test_quality_on_held_out_labels(spark, documents, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = crf.quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.95
    bad = labels.limit(0).unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int"))
    rows = crf.quality(odd, bad).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and crf.quality(none, labels).count() == 0
    assert crf.keep_good(odd, labels).columns == odd.columns


# ---------------------------------------------------------------- 8


def test_subset_sums_are_exact():
    rng = np.random.default_rng(2)
    for _ in range(40):
        lengths = np.unique(rng.integers(1, 30, rng.integers(1, 6)))
        counts = rng.integers(1, 4, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        reach = {sum(a * b for a, b in zip(k, lengths, strict=True)) for k in itertools.product(*(range(c + 1) for c in counts))}
        take = mixing._subset_sum(lengths, counts, budget)
        assert (take <= counts).all() and int((take * lengths).sum()) == max(r for r in reach if r <= budget)


def test_mix_meets_its_targets(spark, documents, odd, none):
    rows = mixing.allot(documents).toPandas()
    again = mixing.allot(documents.repartition(3)).toPandas()
    key = ["doc_id", "copies"]
    assert sorted(map(tuple, rows[key].values)) == sorted(map(tuple, again[key].values))
    joined = rows.merge(documents.select("doc_id", "source", "text").toPandas(), on="doc_id")
    assert (joined["size"] == joined.text.map(lambda t: len(re.findall(SPACED, t)))).all()
    by = joined.assign(taken=joined["size"] * joined.copies).groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    weight = np.array([(3, 1, 2)[i % 3] for i in range(len(by))], float)
    want, free, left = np.zeros(len(by)), np.ones(len(by), bool), 1.5 * by["size"].sum()
    while True:
        want = np.where(free, weight * left / weight[free].sum(), want)
        over = free & (want > 2 * by["size"])
        if not over.any():
            break
        want = np.where(over, 2.0 * by["size"], want)
        free &= ~over
        left = 1.5 * by["size"].sum() - want[~free].sum()
    assert np.allclose(by.target, want) and (abs(by.taken - by.target) < 60).all() and joined.copies.between(0, 2).all()
    odd_rows = mixing.allot(odd).collect()
    assert len(odd_rows) == odd.count() and mixing.allot(none).count() == 0
    assert mixing.mix(odd).columns == odd.columns and mixing.mix(odd).count() == sum(r.copies for r in odd_rows) and mixing.mix(none).count() == 0


def test_one_large_length_is_dealt_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    rows = mixing.allot(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))).toPandas()
    assert rows.copies.sum() == 1500


# ---------------------------------------------------------------- 9


def test_languages(spark, documents, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count() and sum(r.lang_pred == "und" for r in rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_one_repeated_text_is_learned(spark):
    rows = [(1, "der eine satz kommt immer wieder vor", "de")] * 400 + [(k, f"the number {k} is written in words here and there", "en") for k in range(2, 200)]
    frame = lambda r, n: spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)
    one, two = langid.fit(frame(rows, 1)), langid.fit(frame(rows[::-1], 7))
    assert set(one.langs) == {"de", "en"} and one.langs == two.langs and np.allclose(one.centroids, two.centroids)


def test_languages_against_brute_force(spark, monkeypatch):
    """Dictionaries of n-grams instead of vectors, and blocks of three centroids."""
    rng = np.random.default_rng(8)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "xyzéa"}
    rows = [(k, " ".join("".join(rng.choice(list(alphabets[la]), 5)) for _ in range(12)), la) for k in range(90) for la in [sorted(alphabets)[k % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    monkeypatch.setattr(langid, "BLOCK", 3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for k, text, _ in rows:
        grams: Counter = Counter()
        data = b" " + text.encode() + b" "
        for i in range(len(data)):
            grams[data[i]] += 1
            if i + 1 < len(data):
                grams[256 + ((data[i] << 8 | data[i + 1]) * 2654435761 % 2**32 >> 21)] += 1
            if i + 2 < len(data):
                grams[2304 + ((data[i] << 16 | data[i + 1] << 8 | data[i + 2]) * 2246822519 % 2**32 >> 20)] += 1
        v = {g: np.sqrt(n) * float(model.idf[g]) for g, n in grams.items()}
        norm = np.sqrt(sum(x * x for x in v.values()))
        sims = [sum(x * float(c[g]) for g, x in v.items()) / norm for c in model.centroids]
        assert got[k].score == pytest.approx(max(sims), abs=1e-5) and got[k].lang_pred == model.langs[int(np.argmax(sims))]


# ---------------------------------------------------------------- 10


def test_unigrams_against_brute_force(spark, documents, texts, odd, none):
    tokens = {i: [*re.findall(SPACED, t.translate(LOWER)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in lm.score(documents).collect():
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert r.score < 0
    rows = lm.score(odd).collect()
    assert len(rows) == odd.count() and sum(r.bits_per_byte is None for r in rows) == 3 and lm.score(none).count() == 0


def test_the_speller_is_a_distribution():
    """Probabilities of all continuations of a prefix by one byte add up to the prefix's own."""
    widths = lm.widths_for(1)
    z, o = np.random.default_rng(0).integers(0, 9, (2, sum(1 << b for b in widths)))
    speller = lm.Speller(lm.state_of(z, o), widths)
    slots, _, node, word = lm.expand([b"a" + bytes([b]) for b in range(33, 255)], widths)
    first = [lm.expand([w], widths)[0][:, :8] for w in (b"ab", b"ac")]
    assert np.array_equal(*first) and node.max() < 256 and word.max() == 221
    total = 0.0
    for b in range(256):
        s, bit, n, _ = lm.expand([bytes([b])], widths)
        p = speller.refined(speller.mixed(*speller.inputs(s[:, :8]), n[:8]), n[:8])
        total += np.prod(np.where(bit[:8] == 1, p, 1 - p))
    assert total == pytest.approx(1)


def _passages_of(words, lexicon):
    """(hash of the context, first token, tokens) of a text's continuations, one token after another."""
    h = [xxhash.xxh64_intdigest(w) for w in words]
    out = []
    for i in range(lm.CONTEXT, len(words)):
        key = 0
        for k in range(1, lm.CONTEXT + 1):
            key = ((key ^ h[i - k]) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
            key ^= key >> 29
        if key % lm.EVERY == 0:
            out.append([key, i, []])
    for n, x in enumerate(out):
        x[2] = tuple(words[x[1] : min(out[n + 1][1] if n + 1 < len(out) else len(words), x[1] + lm.LONGEST)])
    return out


def test_scores_against_brute_force(spark, monkeypatch):
    """Every decision made one after another, with the trained weights."""
    monkeypatch.setattr(lm, "HEAVY", 40)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = list(rng.choice(vocabulary, 90))
    texts = [" ".join([*rng.choice(vocabulary, 12), *passage[k % 7 : 60 + k], *rng.choice(vocabulary, 9), f"odd{k}x"]) for k in range(40)] + ["", "one", texts_again := " ".join(passage), texts_again]
    rows = [(k, t) for k, t in enumerate(texts)]
    out, model = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.score for r in out.collect()}
    words = {k: [*lm.tokens_of(t.encode()), lm.END] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows}
    seen: dict = {}
    for k, w in words.items():
        for key, _, tokens in _passages_of(w, model.lexicon):
            if not held[k]:
                seen.setdefault(key, Counter())[tokens] += 1
    codes = {}
    for w in words.values():
        p = lm.passages([b" ".join(w[:-1])], model.lexicon, lm.Numbers(model.lexicon.numbers))
        mine = _passages_of(w, model.lexicon)
        assert [(k, i, len(t)) for k, i, t in mine] == list(zip(p.keys.view(np.uint64).tolist(), p.start.tolist(), p.size.tolist(), strict=True))
        for (_, _, tokens), c in zip(mine, p.codes.tolist(), strict=True):
            assert codes.setdefault(tokens, c) == c
    assert len(set(codes.values())) == len(codes)
    share = lambda w: model.lexicon.share[model.lexicon.numbers[w]] if w in model.lexicon.numbers else model.lexicon.others + model.speller.cost([w])[0]
    hits = 0
    for k, w in words.items():
        want = sum(map(share, w))
        for key, _, tokens in _passages_of(w, model.lexicon):
            if key not in seen:
                continue
            top = max(seen[key], key=lambda t: (seen[key][t], codes[t]))
            n, total = seen[key][top] - (not held[k] and top == tokens), sum(seen[key].values()) - (not held[k])
            if n <= 0 or total <= 0:
                continue
            number = model.lexicon.numbers.get(top[0], lm.RARE)
            kind = 6 if number == lm.RARE else sum(number >= x for x in (1, 64, 1024, 8192, 32768))
            pure = (n / total >= 0.5) + (n / total >= 0.75) + (n == total)
            cell = len(top) << 20 | kind << 17 | (number * 2654435761 >> 7 & 4095) << 5 | min(int(np.log2(n)), 7) << 2 | pure
            p = model.matcher.probability(np.array([cell]))[0]
            want += np.log10(p) - sum(map(share, tokens)) if tokens == top else np.log10(1 - p)
            hits += tokens == top
        assert got[k] == pytest.approx(want, rel=1e-5), k
    assert hits > 50


def test_scoring_holds_little_in_a_worker(spark, monkeypatch):
    """Workers of their own, by a setting of their environment; of those, the most memory that one has held."""
    monkeypatch.setitem(spark.sparkContext.environment, "QUILLBIN_TEST", "memory")

    def peak(batches):
        for _ in batches:
            with open("/proc/self/status") as f:
                yield pa.RecordBatch.from_arrays([pa.array([int(line.split()[1]) // 1024]) for line in f if line.startswith("VmHWM")], ["mb"])

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").coalesce(1)
    lm.score(docs).write.format("noop").mode("overwrite").save()
    peaks = [r.mb for r in spark.range(16).repartition(4).mapInArrow(peak, "mb long").collect()]
    assert peaks and max(peaks) < 330, peaks


def test_the_words_before_change_a_words_cost(spark):
    rng = np.random.default_rng(4)
    passage = list(rng.choice([f"word{k}" for k in range(300)], 200))
    shuffled = list(rng.permutation(passage))
    held = [k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    rows = [(k, " ".join([*rng.choice(passage, 50), *passage])) for k in range(60)] + [(held[0], " ".join(passage)), (held[1], " ".join(shuffled))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    same, other = got[held[0]], got[held[1]]
    assert same.base_score == pytest.approx(other.base_score) and same.score > other.score + 100


def test_a_common_word_costs_less_after_its_word(spark):
    """Pairs of words in ever new orders: no three words come again, so no continuation is announced."""
    rng = np.random.default_rng(5)
    held = [k for k in range(300, 400) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    deal = lambda: rng.permutation(400)[:60]
    rows = [(k, " ".join(f"a{j} b{j}" for j in deal())) for k in range(300)]
    pairs = deal()
    rows += [(held[0], " ".join(f"a{j} b{j}" for j in pairs)), (held[1], " ".join(f"a{j} b{i}" for j, i in zip(pairs, np.roll(pairs, 1), strict=True)))]
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    paired, apart = got[held[0]], got[held[1]]
    assert paired.base_score == pytest.approx(apart.base_score) and paired.score > apart.score + 30
    assert paired.score > 0.75 * paired.base_score  # half of the words are all but certain


def test_codes_of_common_words_against_brute_force(spark, monkeypatch):
    """Tree, slots, counts and states bit after bit, then the mixer's formula with the trained weights. Every third word is new, so no continuation comes."""
    monkeypatch.setattr(lm, "HEAVY", 30)
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{j}" if i % 3 else f"x{k}x{i}" for i, j in enumerate(np.minimum(rng.geometric(0.08, rng.integers(0, 120)), 45)))) for k in range(60)] + [(60, None), (61, "once")]
    out, model = lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), before=lm.BEFORE)
    got = {r.doc_id: r.score for r in out.collect()}
    coder, numbers = model.coder, model.lexicon.numbers
    assert 20 < coder.others == len(numbers) <= 30
    mask, mult = (1 << 64) - 1, 0x9E3779B97F4A7C15
    words = {k: [*lm.tokens_of((t or "").encode()), lm.END] for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    codes = [coder.steps[a:b].tolist() for a, b in zip(coder.start, coder.start[1:], strict=False)]
    assert len({tuple(sorted(c)) for c in codes}) == len(codes) and sum(2.0 ** -len(c) for c in codes) == 1

    def steps(k):
        ids = [numbers.get(w, lm.RARE) for w in words[k]]
        for i, number in enumerate(ids):
            for step in codes[min(number, coder.others)]:
                slots = []
                for p, distances in enumerate(lm.BEFORE):
                    h = p + 1
                    for d in distances:
                        h = ((h ^ (ids[i - d] if i >= d else lm.RARE + 1)) * mult) & mask
                        h ^= h >> 29
                    slots.append((p, (((h + (step // 2 + 1) * 0xD6E8FEB86659FD93) * mult) & mask) >> (64 - coder.width)))
                yield step // 2, step % 2, slots

    seen, level = {}, {}
    tokens = Counter(numbers.get(w, lm.RARE) for k in words if not held[k] for w in words[k])
    for k in words:
        for _, bit, slots in steps(k) if not held[k] else ():
            for s in slots:
                seen.setdefault(s, [0, 0])[bit] += 1
    for node in range(coder.others):
        side = [sum(tokens[min(n, lm.RARE)] if n < coder.others else tokens[lm.RARE] + 1 for n, c in enumerate(codes) if 2 * node + b in c) for b in (0, 1)]
        level[node] = sum(np.log(side[1] / side[0]) >= e for e in coder.EDGES)
    for k, w in words.items():
        want = sum(model.speller.cost([x])[0] for x in w if x not in numbers)
        for node, bit, slots in steps(k):
            own = [level[node]]
            for s in slots:
                z, o = seen.get(s, (0, 0))
                z, o = (min(int(np.ceil(n * (255 / max(z, o, 255)))), 255) for n in (z, o))
                if not held[k] and max(z, o) < 255:
                    z, o = z - (bit == 0), o - (bit == 1)
                one, share = z == 0 or o == 0, np.log((o + 0.4) / (z + 0.4))
                often = 13 + 2 * sum(share >= e for e in (-2, -1.3, -0.7, -0.25, 0.25, 0.7, 1.3, 2)) + (z + o >= 24)
                own.append(0 if z + o == 0 else 1 + 2 * min(int(np.log2(z + o)), 5) + (o > 0) if one else often)
            s = [coder.stretch[p][v] for p, v in enumerate(own)]
            sets = coder.weights[0, own[1] * 32 + own[2]] + coder.weights[1, own[3] * 32 + own[2]]
            x = sum(a * b for a, b in zip(sets, s, strict=True)) / 2
            p = np.clip((1 / (1 + np.exp(-x)) + np.interp(np.clip(x, -7.999, 7.999), np.linspace(-8, 8, coder.KNOTS), coder.map[own[0]])) / 2, 1e-6, 1 - 1e-6)
            want += np.log10(p if bit else 1 - p)
        assert got[k] == pytest.approx(want, rel=1e-5), k


def test_word_mixing_does_not_depend_on_how_the_input_is_cut(spark):
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(k, " ".join(f"w{j}" for j in rng.geometric(0.02, 60))) for k in range(80)], "doc_id long, text string")
    a, b = (lm.scored(docs.repartition(n, "doc_id"), before=lm.BEFORE)[1].coder for n in (1, 3))
    assert np.array_equal(a.states, b.states) and np.array_equal(a.cost, b.cost)


def test_scoring_leaves_no_broadcast_on_the_drivers_disk(spark):
    """Of every broadcast the driver holds a file until it is destroyed."""
    files = lambda: {p: p.stat().st_size for p in Path(spark.sparkContext._temp_dir).rglob("*") if p.is_file()}
    before = files()
    out, _ = lm.scored(spark.createDataFrame([(k, f"some words and word{k}") for k in range(40)], "doc_id long, text string"), before=lm.BEFORE)
    assert out.count() == 40 and sum(n for p, n in files().items() if p not in before) < 1 << 20


def test_counts_of_slots_travel_packed():
    """Large counts as they are; of the usual small ones, less than their lowest bytes and an eighth."""
    rng = np.random.default_rng(8)
    for kind in (np.int32, np.int64):
        wide = rng.integers(-(2**31), 2**31, (2, 1000)).astype(kind)
        assert np.array_equal(lm._opened(lm._packed(wide), kind), wide.ravel())
        small = np.minimum(rng.geometric(0.02, lm.CHUNK), 255).astype(kind)
        assert np.array_equal(lm._opened(lm._packed(small), kind), small) and len(lm._packed(small)) < lm.CHUNK * 9 // 8


def test_encoder_equals_the_library_on_odd_words():
    with open(pfor._default_tokenizer(), encoding="utf-8") as f:
        encode = pfor.Encoder(f.read())
    odd = [
        "J\u030c K\u030a E\u0301X", "A<|endoftext|>B Ok.", "<|EndOfText|> x", "it's IT'S don't' ''s x'", "É.É éX, ÑÑ!!", "İstanbul İ", "a\x1cb\x85c d", "word<| w|>. <|", "ª º µ² ǅ ß ẞ", "12abc34, a.b.c... --- x-y",
        "a\u200bb \ufeffc", "", " ", "x" * 500 + "." * 200, "Word, word, WORD, word; WORD's",
    ]
    for text in odd + odd[::-1]:  # the second time from the cache
        assert encode(text.encode()) == np.array(encode.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_quality_sample_passes_over_one_long_document(spark):
    lines = lambda y, k: "\n".join(f"{'A clean line of words, number' if y else 'buy||| CHEAP!!! ###'} {k} {j}" for j in range(3))
    rows = [(0, "one short line\n" * 5000)] + [(k, lines(k % 2, k)) for k in range(1, 200)]
    labels = spark.createDataFrame([(k, 1 if k == 0 else k % 2) for k, _ in rows], "doc_id long, quality int")
    fits = [crf.fit(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, sample_lines=2000) for n, r in ((1, rows), (7, rows[::-1]))]
    assert np.array_equal(fits[0].w, fits[1].w) and np.array_equal(fits[0].scale, fits[1].scale) and np.abs(fits[0].w).max() > 0.1
    good, bad = fits[0].score([lines(1, 500).encode(), lines(0, 500).encode()])
    assert good > 0.7 and bad < 0.3


def test_quality_score_against_brute_force(spark):
    from itertools import product

    rng = np.random.default_rng(5)
    rows = [(k, "\n".join("".join(rng.choice(list("abcXYZ019 !|.é"), 12)) for _ in range(1 + k % 5))) for k in range(60)]
    docs = spark.createDataFrame([*rows, (60, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows], "doc_id long, quality int")
    model = crf.fit(docs, labels)
    got = {r.doc_id: r.score for r in crf.quality(docs, labels).collect()}
    for k, text in [*rows[::7], (60, "")]:
        x, sizes, _ = crf.line_features([text.encode()])
        s = x @ model.w
        weight = {y: np.exp(sum(s[i] * y[i] for i in range(len(s))) + sum(model.trans[a, b] for a, b in zip(y, y[1:], strict=False))) for y in product((0, 1), repeat=len(s))}
        good = [sum(w for y, w in weight.items() if y[i]) / sum(weight.values()) for i in range(len(s))]
        mean = min(max(np.average(good, weights=[len(line.encode()) + 1 for line in text.split("\n")]), 3e-4), 1 - 3e-4)
        want = 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * np.log(mean / (1 - mean)))))
        assert abs(got[k] - want) < 1e-9
