"""Sharding, periodic runs and collocations against brute force, over edge cases."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerleaf.llm import collocations, licenses, periodic_runs, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, size string, slot string, bucket string, h1 string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, "s", None, "k", "s", "t", "b", "h") for d, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(0, 120)) for _ in range(60)]
    texts += ["a " * 300, "a b " * 40 + "c", "x" + " ab c" * 9 + " ab", prose(7) + (" " + prose(9)) * 1, " ".join([prose(23)] * 6), " ".join([prose(64)] * 4), " ".join([prose(65)] * 5 + ["end"])]
    texts += [None, "", " \n\t\x0b\x0c\r ", "one", "A a A a A a", "\x85 \x85 \x85\x1c \x85", prose(5000)]
    texts += ["the same copy, twice"] * 30 + ["Tab\there: two! words? The same copy"] * 12
    rows = [(i, t, ("en", "de", None, "und")[i % 4]) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, texts[61], "en"), (None, None, None), (5, "another text of 5", "de")]


def brute_runs(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, m, q) for (s, m), q in found.items())


def test_find_runs():
    rng = random.Random(3)
    for exponent, least in ((4, 6), (2, 2), (3, 5)):
        for _ in range(60):
            docs, numbers, ends, used = [], [], [], 0
            for _ in range(rng.randint(1, 5)):
                k, w = rng.choice((1, 2, 2, 3, 30)), []
                for _ in range(rng.randint(0, 6)):
                    piece = [rng.randrange(k) for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 33)))]
                    w += piece * rng.choice((1, 1, 2, 4, 5, 9)) + piece[: rng.randint(0, len(piece))]
                docs.append(w)
                numbers += [x + used for x in w]
                used += k
                ends.append(len(numbers))
            got = list(zip(*(c.tolist() for c in periodic_runs.find_runs(np.array(numbers, np.int64), np.array(ends), exponent, least))))
            want, at = [], 0
            for w in docs:
                want += [(s + at, m, q) for s, m, q in brute_runs(w, exponent, least)]
                at += len(w)
            assert got == want


def test_periodic_runs_digest(spark, corpus):
    def expected(d, t):
        w = re.findall(r"[^\x20\x09-\x0d]+", t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (d, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))

    got = periodic_runs.digest(frame(spark, corpus)).collect()
    assert sorted((str(tuple(r)) for r in got)) == sorted(str(expected(d, t)) for d, t, _ in corpus)
    assert sum(r.n_runs > 0 for r in got) >= 10
    assert periodic_runs.digest(frame(spark, [])).count() == 0


def test_runs_of_a_long_text():
    n = 400_000
    words = np.zeros(n, np.int64)  # one word all along
    assert [c.tolist() for c in periodic_runs.find_runs(words, np.array([n]))] == [[0], [n], [1]]
    words = np.r_[np.arange(1, 100_001), np.tile(np.arange(100_001, 150_001), 5), np.arange(200_000, 250_000)]
    assert [c.tolist() for c in periodic_runs.find_runs(words, np.array([len(words)]))] == [[100_000], [250_000], [50_000]]


def loads(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for shard, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return {s: sum(r.size for r in own) for s, own in by.items()}


def test_sharding(spark, corpus):
    got = sharding.digest(frame(spark, corpus)).collect()
    sizes = sorted(str((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))) for d, t, _ in corpus)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sizes
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}
    shards = defaultdict(set)
    for r in got:
        shards[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())
    groups, heap = Counter(), [0] * 16  # every group is dealt by itself here, as the plain rule does
    for _, t, _ in corpus:
        groups[t or ""] += len((t or "").encode()) + 1
    for size in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + size)
    assert sorted(heap) == sorted([*loads(got).values()])
    assert sharding.digest(frame(spark, [])).count() == 0


def test_sharding_of_bundles(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rng = random.Random(4)
    rows = [(i, " ".join(str(rng.randrange(1000)) for _ in range(rng.randint(1, 30))), None) for i in range(3000)]
    rows += [(5000 + i, "one text that a tenth of all rows have, all of them in one shard", None) for i in range(300)]
    docs = frame(spark, rows)
    got = sharding.shard(docs, shards=8, fine=16).collect()
    load = loads(got)
    assert len({r.shard for r in got if r.doc_id >= 5000}) == 1
    assert max(load.values()) - min(load.values()) < sum(load.values()) / 8 / 16 * 2.5
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs, shards=8, fine=16).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    sharding.write_shards(docs, str(tmp_path / "out"), 8, 16, files=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, int(r.shard)) for r in back.select("doc_id", "shard").collect()) == sorted((r.doc_id, r.shard) for r in got)


def phrases_of(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
        yield re.findall(r"[^\x20\x09]+", piece)


def test_equal_partitions():
    rng = np.random.default_rng(4)
    for m in (0, 1, 50, 3000):
        keys = rng.integers(1, 9, (3, m))
        keys[2, keys[1] > 6] = 0
        keys[1:, keys[0] > 7] = 0
        weights = rng.integers(1, 4, m)
        want = Counter()
        for k, w in zip(keys.T.tolist(), weights.tolist()):
            want[tuple(x for x in k if x)] += w
        one, size, count = collocations.equal_partitions(keys, weights, 5)
        got = {tuple(keys[:k, p].tolist()): c for p, k, c in zip(one.tolist(), size.tolist(), count.tolist())}
        assert len(got) == len(one) and got == {k: c for k, c in want.items() if c >= 5}


@pytest.mark.parametrize("words", [3, 4])
def test_collocations(spark, corpus, words, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 500)
    monkeypatch.setattr(collocations, "BUCKETS", 5)
    rows = corpus + [(900 + i, "New York, new\tyork city. NEW YORK city hall? the red fox" + "; the\x85x y" * (i % 3), None) for i in range(14)]
    f, total = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        for w in phrases_of(t):
            total[lang or "und"] += len(w)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    want = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in some.items():
            score, cut = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            if not any(100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in some.items() if len(q) > len(p)):
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:40], 1):
            want.append((lang, rank, p.decode(), -a, x, y, total[lang], -s))
    got = collocations.top_collocations(frame(spark, rows), top=40, max_words=words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 20
    assert {t for _, t in got.dtypes} == {"string", "bigint"}
    assert collocations.top_collocations(frame(spark, [])).count() == 0


def test_long_texts_are_cut_between_pieces():
    text = b"one two. three four five, six " * 100 + b"word " * 5000
    parts = list(collocations._pieces(text, 1000))
    assert len(parts) > 2
    assert [w for t in parts for w in phrases_of(t.decode()) if w] == [w for w in phrases_of(text.decode()) if w]


#: Published wordings, with their own punctuation and line ends.
PUBLISHED = {
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


@pytest.mark.parametrize("label", PUBLISHED)
def test_published_licenses(label):
    scanner = licenses.Scanner()
    found = {(x, score) for _, _, x, score, _ in scanner.matches(licenses.words("intro\n\n" + PUBLISHED[label] + "\n"))}
    assert (label, 1.0) in found
    broken = licenses.words(PUBLISHED[label].replace("software", "hardware").replace("SOFTWARE", "HARDWARE"))
    assert (label, 1.0) not in {(x, score) for _, _, x, score, _ in scanner.matches(broken)}


def test_secrets_apart(spark):
    """Candidates that overlap base spans before, behind, within and around them."""
    rng = random.Random(6)
    mixed = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789+/") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    pieces = [lambda: mixed(40), lambda: hexed(40), lambda: f"token={mixed(30)}", lambda: f"{mixed(20)}_AKIA{'Q7' * 9}", lambda: f"{mixed(9)}{hexed(26)}{mixed(12)}", lambda: hexed(20).upper() + hexed(20), lambda: "plain words here"]
    texts = ["".join(rng.choice(pieces)() + rng.choice((" ", "\n", "/", "", "-")) for _ in range(rng.randint(0, 90))) for _ in range(40)]
    rows = secrets.with_spans(frame(spark, [(i, t, None) for i, t in enumerate(texts)]).select("doc_id", "text")).select("row.text", "base", "more").collect()
    assert sum(len(r.more) for r in rows) > 200 and sum(len(r.base) for r in rows) > 200
    for r in rows:
        taken = [(b.start, b.finish) for b in r.base]
        for name, (pattern, _, _) in secrets.CANDIDATES.items():
            ranks = [secrets.KINDS.index("entropy_hex")] if name == "entropy_hex" else [secrets.KINDS.index(k) for k in secrets._RUNS]
            free = {(m.start(), m.end()) for m in re.finditer(pattern, r.text) if not any(s < m.end() and m.start() < e for s, e in taken)}
            own = {(x.start, x.finish) for x in r.more if x.rank in ranks}
            assert own <= free
            taken += own


def test_very_many_secrets_in_one_text(spark):
    import time

    rng = random.Random(7)
    lines = [f"token={i:06d}{''.join(rng.choice('abcdefgh23456789') for _ in range(10))} {''.join(rng.choice('ABCDEFGHKLMNPQRSTUVWXYZabcdefghkmnpqrstuvwxyz23456789') for _ in range(32))}" for i in range(50_000)]
    docs = frame(spark, [(1, "\n".join(lines), None)])
    began = time.perf_counter()
    row = secrets.scan(docs).first()
    assert time.perf_counter() - began < 60
    assert row.n_assign == 50_000 and row.n_entropy > 45_000
