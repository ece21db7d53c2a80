"""The ten operators against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenloom.llm import bpe, common, licenses, lines, media, packing, quality, simhash, suffixes, urls, winnow  # noqa: E402

WORDS = "the of and river stone écran über 中文 naïve light under mountain gold seven grass o'clock it's 1995 3.14 MIT license Apache".split()


def text(rng: random.Random, n: int) -> str:
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", ", ", ". "]) for _ in range(n))


def corpus(seed: int = 1) -> list[tuple]:
    """Ids and texts with nulls, empty texts, copies, near copies, shared passages and one long text."""
    rng = random.Random(seed)
    texts = [text(rng, rng.randint(5, 120)) for _ in range(60)]
    passage = text(rng, 80)
    line = "this very line is found in many documents of the table"
    texts += [texts[0], texts[0], texts[1] + " changed", passage + texts[2], texts[3] + passage, texts[4] + passage + texts[5]]
    texts += [f"{t}\n  {line.upper() if i % 2 else line}\t\nend {i}" for i, t in enumerate(texts[6:11])]
    texts += [None, "", " \n\t ", "x", "ab " * 3000, "é" * 500, text(rng, 20_000)]
    return list(enumerate(texts)) + [(None, texts[7]), (3, texts[3]), (3, "another text with an id that is there already")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.5, 7) for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n_tokens long").repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_bpe(docs, empty):
    import tiktoken

    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={})
    made = bpe.decode(bpe.encode(docs))
    by_text = {}
    for i, t in corpus():
        by_text.setdefault(i, []).append(t or "")
    for r in made.toLocalIterator():
        t = r["decoded"].decode()
        assert t in by_text[r["doc_id"]]
        assert r["ids"] == want.encode_ordinary(t)
        assert all(a <= b for a, b in zip(r["starts"], r["starts"][1:])) and len(r["starts"]) == len(r["ids"])
    assert bpe.encode(empty).count() == 0
    assert bpe.decode(docs.limit(1).withColumn("ids", F.lit(None).cast("array<int>"))).first()["decoded"] is None


def odd_text(rng: random.Random) -> str:
    parts = ["a", "B", "word", "İ", "ß", "🦜", "中文", "e\u0301", "\u00a0", "\u2003", "\u3000", " ", "  ", "\n", "\r\n", "\t", "1", "23", "'s", "'", "<", "|", ">", "<|", "|>", "\x00", "\x01", "ﷺ", "٣", "…"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))


def test_bpe_places_and_split_characters(spark):
    """Ids, bytes, places and split characters of odd texts, each token's worked out from the rank file alone."""
    rng = random.Random(8)
    texts = ["a🦜b", "🦜🦜 🦜", *(odd_text(rng) for _ in range(400))]
    by_id = {r: t for t, r in bpe.read_ranks(public_tokenizers.path(bpe.RANKS)).items()}
    want = tiktoken_ids()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    seen = 0
    for r in bpe.decode(bpe.encode(df)).collect():
        t = texts[r["doc_id"]]
        assert r["ids"] == want(t) and bytes(r["decoded"]) == t.encode()
        at, places, split = 0, [], 0
        for i in r["ids"]:
            inside = at < len(t.encode()) and t.encode()[at] & 0xC0 == 0x80
            places.append(len(t.encode()[:at].decode(errors="ignore")))
            split += inside
            at += len(by_id[i])
        assert (r["starts"], r["n_split"]) == (places, split)
        seen += split
    assert seen
    cut = spark.createDataFrame([(want("🦜")[:1],), ([],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in bpe.decode(cut).collect()] == [by_id[want("🦜")[0]], b""]
    with pytest.raises(Exception, match="(?i)no token|index"):
        bpe.decode(spark.createDataFrame([([10**6],)], "ids array<int>")).collect()


def tiktoken_ids():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)), special_tokens={}).encode_ordinary


def walks(words: list[str], t, k: int = 0, at: int | None = None) -> bool:
    """Whether a notice's words stand in order, with few others between them and none that bars it."""
    if k == len(t.order):
        return True
    if at is None:
        return any(walks(words, t, 1, i) for i, w in enumerate(words) if w == t.order[0])
    ends = range(at + 1, min(at + licenses.GAP + 2, len(words)))
    return any(words[j] == t.order[k] and not set(words[at + 1 : j]) & set(t.between) and walks(words, t, k + 1, j) for j in ends)


def test_licenses(docs, empty):
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = {}
    for i, t in corpus():
        low = (t or "").translate(lower)
        words = re.findall(licenses.WORD, low)
        places, base = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        labels, score = set(base), 1.0 if base else 0.0
        for t in licenses.templates():
            starts = range(0, max(1, -(-len(words) // t.step) - 1), 1)
            for k in starts:
                block = set(words[k * t.step : (k + 2) * t.step])
                n = len(block & set(t.words))
                if n >= t.least and block >= set(t.must) and not block & set(t.must_not) and (not t.order or walks(words, t)):
                    labels.add(t.label)
                    score = max(score, 1.0 if t.order else n / len(t.words) * licenses.SET_SCORE)
        want.setdefault(i, []).append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
    assert {k: sorted(map(repr, v)) for k, v in got.items()} == {k: sorted(map(repr, v)) for k, v in want.items()}
    assert licenses.scan(empty).count() == 0


def license_labels(spark, texts: list[str]) -> list[tuple]:
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [tuple(r)[1:] for r in licenses.scan(df).orderBy("doc_id").select("doc_id", "n_base", "labels", "score").collect()]


def test_license_notices_and_their_siblings(spark):
    """Each short notice has its own label and no sibling's; words of notices here and there have none."""
    cases = {
        "mit license mit license": (2, "mit"), "The MIT licence": (0, ""), "Released under MIT License.": (1, "mit"), "Released under the MIT License.": (1, "mit,notice-mit"),
        "Released under the Apache License": (1, "apache"), "Licensed under the Apache License, Version 2.0": (1, "apache,notice-apache-2.0"),
        "Licensed under CC BY 4.0": (0, "notice-cc-by-4.0"), "Licensed under CC BY-SA 4.0": (0, "notice-cc-by-sa-4.0"), "Licensed under CC BY-NC 4.0": (0, "notice-cc-by-nc-4.0"),
        "Licensed under CC BY-ND 4.0": (0, "notice-cc-by-nd-4.0"), "Licensed under CC BY-NC-SA 4.0": (0, "notice-cc-by-nc-sa-4.0"), "Licensed under CC BY-NC-ND 4.0": (0, "notice-cc-by-nc-nd-4.0"),
        "This work is licensed under a Creative Commons Attribution 4.0 International License": (0, "notice-cc-by-4.0"),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": (0, "notice-cc-by-sa-4.0"),
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": (0, "notice-cc-by-nc-4.0"),
        "This work is licensed under the GNU General Public License, version 3.": (1, "gpl,notice-gpl-3.0"), "under the GNU General Public License, version 2": (1, "gpl,notice-gpl-2.0"),
        "GPL version 2": (0, "notice-gpl-2.0"), "GNU Lesser General Public License": (1, "gpl,notice-lgpl"), "GNU Affero General Public License version 3": (1, "gpl,notice-agpl-3.0"),
        "Released by the city library for students of MIT under a new license plan": (0, ""), "Mit freundlichen Grüßen, under the license": (0, ""),
        "Version 2.0 of the apache helicopter manual needs no driver license": (0, ""), "The public and general gnu herd: license version 2": (0, ""),
        "CC BY 4.0 or CC BY-SA 4.0": (0, "notice-cc-by-4.0,notice-cc-by-sa-4.0"), "under the terms of the MIT license": (1, "mit,notice-mit"), "under the the the the mit license": (1, "mit,notice-mit"),
        "GPL of LGPL version 2": (0, ""), "under the a b c d mit license": (1, "mit"),
        "The report was released under the old license of the town council": (0, ""), "the institute said mitigation under a license": (0, ""), "": (0, ""),
    }
    assert [r[:2] for r in license_labels(spark, list(cases))] == list(cases.values())


def test_license_texts_across_lines(spark):
    """Each licence's text, wrapped at a few words a line and among other words, has its label and no other text's."""
    rng = random.Random(2)
    other = "river stone mountain gold seven grass light forest cloud".split()
    texts, want = [], []
    for label, text, _, _ in licenses.TEXTS:
        w = text.split()
        for k in (0, 37):
            lines = [" ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
            texts.append("\n".join([" ".join(rng.choices(other, k=k)), *(" * " + x for x in lines), " ".join(rng.choices(other, k=500 * bool(k)))]))
            want.append(label)
    got = license_labels(spark, texts)
    for label, (_, labels, score) in zip(want, got):
        assert [x for x in labels.split(",") if x.startswith("text-")] == [label] and score >= licenses.SET_SCORE
    # four fifths of the words are enough, three quarters aren't
    own = sorted(set(re.findall(licenses.WORD, licenses.TEXTS[0][1].lower())))
    must = ["sublicense", "noninfringement"]
    rest = [w for w in own if w not in must]
    parts = [" ".join(must + rest[: int(len(own) * share) - 1]) for share in (0.82, 0.75)]
    assert [r[1] for r in license_labels(spark, parts)] == ["text-mit", ""]


def test_license_templates_of_any_length(spark):
    """A template of more words than any step has blocks of its own size."""
    rng = random.Random(5)
    own = [f"w{i}" for i in range(700)]
    known = [licenses.template("long", " ".join(own), 0.8)]
    texts = ["x " * 333 + " ".join(own) + " y" * 900, " ".join(rng.sample(own, 600)), " ".join(own[:500]), ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["labels"] for r in licenses.scan(df, known=known).orderBy("doc_id").collect()] == ["long", "long", "", ""]
    with pytest.raises(ValueError):
        licenses.template("none", " . ", 0.8)


def test_license_clashing_names(spark):
    df = spark.createDataFrame([(1, "mit license", "a", "b")], "id long, text string, digest string, words string")
    assert licenses.scan(df, id_col="id").first()["labels"] == "mit"
    with pytest.raises(ValueError, match="labels"):
        licenses.scan(df.withColumnRenamed("id", "labels"), id_col="labels")


def brute_lines(rows):
    """By rows: every row is a document."""
    keys = {}
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            k = line.encode().strip(b" \t\n\r\x0b\x0c").lower().decode()
            if len(k) >= 20:
                keys.setdefault(k, {})[n] = common.NULL_ID if i is None else i
    made = []
    for i, t in rows:
        own, kept = (t or "").split("\n"), []
        for line in own:
            at = keys.get(line.encode().strip(b" \t\n\r\x0b\x0c").lower().decode(), {})
            if len(at) < 3 or max(at.values()) == (common.NULL_ID if i is None else i):
                kept.append(line)
        made.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(map(repr, made))


def test_lines(docs, empty):
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"].decode()) for r in lines.drop_repeated_lines(docs).collect()]
    assert sorted(map(repr, got)) == brute_lines(corpus())
    assert any(g[2] for g in got)
    assert lines.drop_repeated_lines(empty).count() == 0


def test_many_equal_rows_cost_what_they_are(spark):
    """Thousands of equal rows, of one id or none: lines and spans of a text are gathered once, not once a row."""
    import time

    rng = random.Random(9)
    body = "\n".join(f"line {i} of a page that very many rows hold {rng.random()}" for i in range(60))
    other = "\n".join(f"line {i} that only stands here, in one row of the table {rng.random()}" for i in range(8))
    rows = [(i, body) for i in (None, 7) for _ in range(2_500)] + [(8, body), (9, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    began = time.monotonic()
    got = {(r["doc_id"], r["n_dropped"]): r["count"] for r in lines.drop_repeated_lines(df).groupBy("doc_id", "n_dropped").count().collect()}
    assert got == {(None, 60): 2_500, (7, 60): 2_500, (8, 0): 1, (9, 0): 1}
    made = suffixes.remove_repeats(df).groupBy("doc_id", "n_removed", "n_spans").count().collect()
    n = len(body)
    assert {(r["doc_id"], r["n_removed"], r["n_spans"]): r["count"] for r in made} == {(None, n, 1): 2_500, (7, n, 1): 2_500, (8, n, 1): 1, (9, 0, 0): 1}
    assert time.monotonic() - began < 240


def test_quality_sample_bounds_rows(spark):
    """An id that very many rows share does not bring more examples than the sample has."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(i, "some other text") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    fit, quality.fit = quality.fit, lambda x, y: seen.append(len(y)) or fit(x, y)
    try:
        quality.train(docs, labels, sample=40)
    finally:
        quality.fit = fit
    assert seen == [40]


def test_lines_are_reversible(spark, docs):
    id_, digest = common.key_columns()
    keyed = docs.select(id_.alias("id"), digest.alias("digest"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    old, new = keyed.filter("id % 3 <> 0"), keyed.filter("id % 3 = 0")
    whole = lines.build(keyed)
    grown = lines.insert(lines.build(old), new)

    def counts(s):
        return sorted(map(tuple, s.counts.collect()))

    def dropped(s):
        return sorted((r["id"], r["digest"], sorted(map(tuple, r["keys"]))) for r in lines.dropped_lines(s).collect())

    assert counts(grown) == counts(whole) and dropped(grown) == dropped(whole)
    shrunk = lines.delete(grown, new)
    assert counts(shrunk) == counts(lines.build(old)) and dropped(shrunk) == dropped(lines.build(old))


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    made = lines.CuckooFilter(5000)
    made.insert(keys)
    assert made.contains(keys).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert made.contains(others).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.01
    again = lines.CuckooFilter.from_bytes(made.to_bytes())
    assert (again.table == made.table).all() and again.stash == made.stash
    full = lines.CuckooFilter(8)
    full.insert(keys[:200])  # far too many: the stash keeps what finds no place
    assert full.contains(keys[:200]).all()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    made = packing.pack(packing.pieces(docs)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = []
    for i, t in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, p, s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, ((r["id"], r["piece"], r["start"], zlib.crc32(r["ids"])) for r in made))) == sorted(map(repr, want))
    by = {}
    for r in made:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r["length"] for r in made) // 4096)
    assert packing.packed_digests(empty).count() == 0


def test_packing_takes_the_files_ids(spark):
    """Texts with the names of added tokens, parts of them and other odd characters: ids as the library gives them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rng = random.Random(6)
    names = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|endoftext|", "hello ", " world"]
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|startoftext|><|endoftext|>x", "<|endof", "text|>", "a<|endoftext|><|endoftext|>b <|EndOfText|>"]
    texts += ["".join(rng.choice(names) if rng.random() < 0.3 else odd_text(rng) for _ in range(6)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in packing.pieces(df).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*tokenizer.encode(texts[r["id"]], add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_is_near_the_lower_bound(spark, seed):
    """Random lengths: no more than one sequence over the sum's bound, or as many as pieces that can't share one."""
    rng = random.Random(seed)
    counts: dict[int, int] = {}
    for _ in range(3000):
        n = min(4096, max(1, int(rng.lognormvariate(6, 1.2))))
        counts[n] = counts.get(n, 0) + 1
    made = sum(t for _, t in packing.minimum_bin_slack(counts, 4096))
    bound = max(-(-sum(n * c for n, c in counts.items()) // 4096), sum(c for n, c in counts.items() if n > 2048))
    assert bound <= made <= bound + 1


def test_minimum_bin_slack():
    made = packing.minimum_bin_slack({6: 2, 5: 1, 4: 3, 3: 2}, 10)
    used = {}
    for pattern, times in made:
        assert sum(n * k for n, k in pattern) <= 10
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * times
    assert used == {6: 2, 5: 1, 4: 3, 3: 2} and sum(t for _, t in made) == 4
    assert sum(t for _, t in packing.minimum_bin_slack({3: 10**9}, 10)) == -(-(10**9) // 3)
    assert packing.minimum_bin_slack({}, 10) == []
    with pytest.raises(ValueError):
        packing.minimum_bin_slack({11: 1}, 10)


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffixes(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = corpus()
    want = sorted(map(repr, zip([i for i, _ in rows], suffixes.brute_force([(t or "").encode() for _, t in rows]))))
    got = [(r["doc_id"], (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest())) for r in suffixes.remove_repeats(docs).collect()]
    assert sorted(map(repr, got)) == want
    assert suffixes.remove_repeats(empty).count() == 0
    assert all(isinstance(r["kept"], str) for r in suffixes.remove_repeats(docs, as_text=True).select("kept").collect())


def test_suffixes_with_edits(spark):
    """Copies of one text with a change at every place: borders of spans have to be exact."""
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(900)).decode()
    texts = [base[:k] + "#" + base[k + 1 :] for k in range(0, 900, 23)] + [base[:210], "z" + base[300:500] + "z", base[300:499], "q" * 450, "q" * 199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(suffixes.brute_force([t.encode() for t in texts])))
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.remove_repeats(df).collect()}
    assert got == want


def test_loser_tree():
    rng = random.Random(2)
    runs = []
    for _ in range(7):
        own = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40)))
        shared, lengths, rests = suffixes.front_code(own)
        assert suffixes.front_decode(shared, lengths, rests) == own
        runs.append((own, shared))
    out = list(suffixes.LoserTree(runs))
    strings = [runs[r][0][i] for r, i, _ in out]
    assert strings == sorted(s for own, _ in runs for s in own)
    for (a, b), (_, _, k) in zip(zip(strings, strings[1:]), out[1:]):
        assert k == suffixes.common_prefix(a, b)


def test_long_text_anchors(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    row, first, count, place, h = suffixes.anchors(data, np.array([0, 1200, 1300, 5000]))
    starts = sorted(s for f, n in zip(first.tolist(), count.tolist()) for s in range(f, f + n))
    assert starts == [*range(0, 1001), *range(1300, 4801)]
    grams = suffixes.gram_hashes(data)
    assert (h == grams[place]).all() and ((place >= first + count - 1) & (place < first + suffixes._SPAN)).all()


def test_urls(spark):
    cases = [
        ("https://A.example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://x.org/q", "x.org", "/q", "org/", "allow"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("ftp://b.com/fr/a", "b.com", "/fr/a", "com/fr/", "allow"),
        ("b.com/fr/a", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://x.org", "x.org", "", None, None), ("http://com/de/://x", "com", "/de/://x", "com/de/", "block"), ("http://a\nb.com/de/", "a\nb.com", "/de/", "com/de/", "block"),
    ]
    df = spark.createDataFrame([(i, c[0], 0.5, "x") for i, c in enumerate(cases)], "page_id long, url string, risk double, host string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block") and verdict in (None, got[i]["verdict"])
        assert 0 <= got[i]["risk"] <= 1
    assert urls.judge(df.limit(0)).count() == 0


def test_urls_alone_in_a_batch(spark):
    for url in (None, "", "x", "a://", "a://b"):
        (r,) = urls.judge(spark.createDataFrame([(None, url)], "page_id long, url string")).collect()
        assert r["page_id"] is None and 0 < r["risk"] < 1 and r["verdict"] in ("allow", "block")


def test_url_rules_of_equal_length(spark):
    df = spark.createDataFrame([("a.b", "/x/y")], "h string, p string")
    rules = [("allow", "b", "/x/"), ("block", "b", "/x/"), ("block", "b", "/x"), ("block", "a.b", "/z")]
    assert df.select(*urls.rule(F.col("h"), F.col("p"), rules)).first()[:] == ("b/x/", "allow")


def test_urls_against_brute_force(spark):
    """All pages: host, path and rule as DuckDB has them, and the model's risk by plain sums over n-grams."""
    import os
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from compare import duck

    sf = "/root/testdata/sf0.001"
    split = """select page_id, case when contains(coalesce(url, ''), '://') then translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
        case when contains(coalesce(url, ''), '://') then regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1) else '' end as path from pages"""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)
    want = {
        r.page_id: (r.host, r.path, r.rule if isinstance(r.rule, str) else None, r.verdict if isinstance(r.verdict, str) else None)
        for r in duck(sf, f"""with s as ({split}), hit as (select page_id, h || p as rule, v as verdict, row_number() over (partition by page_id order by length(h || p) desc) as k
            from s join (values {values}) r(v, h, p) on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
            select s.*, rule, verdict from s left join hit on hit.page_id = s.page_id and k = 1""").itertuples()
    }
    weights, bias = urls.train()
    step, low = 0x100000001B3, (1 << 64) - 1

    def risk(host: str, path: str) -> float:
        slots = set()
        for seed, framed in ((1, f"^{host}$"), (2, f"{path}$")):
            raw = [48 if 48 <= b <= 57 else b for b in framed.encode()]
            for n in urls.SIZES:
                for i in range(len(raw) - n + 1):
                    h = seed * 31 + n
                    for b in raw[i : i + n]:
                        h = (h ^ b) * step & low
                    slots.add((h ^ h >> 29) % (1 << urls.BITS))
        total = bias + sum(weights[s] for s in sorted(slots)) / max(1, len(slots)) ** 0.5
        return 1 / (1 + np.exp(-total))

    got = urls.op7_url_filter(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        host, path, rule, verdict = want[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        own = risk(host, path)
        assert abs(r["risk"] - own) < 1e-9
        assert r["verdict"] == (verdict or ("block" if own >= 0.5 else "allow"))


def test_url_model_on_unseen_urls(spark):
    bad = ["http://mega-casino.net/bonus", "https://cheap-pills-now.example.com/en/4", "http://xxx-adult.example.net/", "https://free-bets-club.info/join"]
    good = ["https://www.gardeners.net/en/77", "https://physics.university.edu/papers", "https://blog.potters.example.net/fr/9"]
    df = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_winnow_places():
    rng = random.Random(4)
    for n in (0, 1, 5, 23, 24, 25, 63, 64, 400):
        raw = bytes(rng.choice(b"ab") for _ in range(n))
        places, hashes = winnow.winnow(raw)
        h = winnow.rolling(np.frombuffer(raw, np.uint8)).tolist()
        w = min(winnow.WINDOW, len(h))
        want = sorted({max(range(i, i + w), key=lambda j: (-h[j], j)) for i in range(len(h) - w + 1)}) if h else []
        assert places.tolist() == want and hashes.tolist() == [h[p] for p in want]
    common_part = bytes(rng.choice(b"abc") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = (winnow.winnow(bytes(rng.choice(b"xyz") for _ in range(50)) + common_part + bytes(rng.choice(b"uvw") for _ in range(30)))[1] for _ in range(2))
    assert len(np.intersect1d(a, b))


def test_winnow_first_match():
    a, b = b"x" * 40 + bytes(range(65, 165)), bytes(range(65, 165)) + b"y" * 30
    one, two = winnow.winnow(a), winnow.winnow(b)
    p, q = winnow.first_match(one, two)
    assert a[p : p + winnow.GRAM] == b[q : q + winnow.GRAM] and p == min(x for x, h in zip(*one) if h in two[1])
    assert winnow.first_match(one, winnow.winnow(b"q" * 99)) == (None, None)


def test_winnow_splits_a_frequent_id(spark):
    """Rows that share an id are dealt out by their digests; borders agree with plain counting."""
    rng = random.Random(5)
    cuts = sorted({(rng.choice([1, 1, 1, 2, 5]), rng.randrange(100)) for _ in range(12)})
    rows = [(rng.randrange(7), rng.randrange(100)) for _ in range(400)]
    got = winnow._Ranges(cuts).part(*(np.array(x, np.int64) for x in zip(*rows)))
    assert got.tolist() == [sum(c < r for c in cuts) for r in rows]
    same = spark.createDataFrame([(None, f"text {i} " * 9) for i in range(300)] + [(None, None)] * 20, "doc_id long, text string")
    made = winnow.edited_likeness(same)
    assert made.count() == 320 and made.filter("doc_id is null").count() == 320


def test_winnow_neighbours(docs, empty, spark):
    rows = [(common.NULL_ID if i is None else i, d, t or "") for i, t, d in ((r["doc_id"], r["text"], r["d"]) for r in docs.select("doc_id", "text", common.key_columns()[1].alias("d")).collect())]
    rows.sort(key=lambda r: (r[0], r[1]), reverse=True)
    want = []
    for n, (i, _, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][2]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        a, b, c = (winnow.winnow(x.encode())[1] for x in (t, edited, after))
        want.append((None if i == common.NULL_ID else i, len(t), hashlib.sha256(edited.encode()).hexdigest(), winnow.digest(a), winnow.digest(b), winnow.likeness(a, b), winnow.likeness(a, c)))
    got = [tuple(r)[:7] for r in winnow.edited_likeness(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert winnow.edited_likeness(empty).count() == 0
    assert winnow.fingerprint(docs).count() == docs.count()


def test_media_items():
    html = '<p>One <b>two</b></p><figure><img src="d1" alt="alt"><figcaption>A <i>caption</i></figcaption></figure>three<img src="d2" alt="own"/><script>var a="<p>no</p>"</script><p>four &amp; five'
    items = media.parse(html)
    assert [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in items] == [
        (0, "text", "One two", None, None), (1, "img", None, "d1", "A caption"), (2, "text", "three", None, None), (3, "img", None, "d2", "own"), (4, "text", "four & five", None, None),
    ]
    assert media.parse(None) == [] and media.parse("") == [] and media.parse("<p><<<") != [None]


def test_media_store(docs, empty, spark):
    raw = docs.select("doc_id", F.col("text").cast("binary").alias("raw"))
    kept = media.store(raw)
    back = {r["digest"]: r for r in media.read_back(kept).collect()}
    for _, t in corpus():
        b = (t or "").encode()
        payload = media.pad(b)
        assert len(payload) % 64 == 0 and len(payload) > 0
        r = back[hashlib.sha256(b).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert media.from_png(media.to_png(payload)).tobytes() == payload
    with pytest.raises(ValueError):
        media.from_png(media.to_png(bytes(64))[:-20] + b"0" * 20)
    pages = spark.createDataFrame([(1, '<img src="a">x<img src="none">'), (2, None)], "page_id long, html string")
    table = spark.createDataFrame([("a", b"1"), ("a", b"1")], "digest string, payload binary")
    found = media.resolve(media.interleave(pages), table).orderBy("position").collect()
    assert [(r["position"], r["payload"]) for r in found] == [(0, b"1"), (1, None), (2, None)]
    assert media.resolve(media.interleave(pages.union(pages)), table, media_only=True).count() == 4
    assert media.resolve(media.interleave(pages.limit(0)), table.limit(0)).count() == 0
    for name in ("text", "page_id"):
        with pytest.raises(ValueError, match=name):
            media.resolve(media.interleave(pages), table.withColumnRenamed("payload", name))
    with pytest.raises(ValueError, match="media"):
        media.store(raw.withColumnRenamed("doc_id", "media"), id_col="media")
    assert media.store(empty.select("doc_id", F.col("text").cast("binary").alias("raw"))).count() == 0


def test_media_in_the_pages_of_documents(spark, docs):
    """Each document's figure stands behind its first line that has text, with its caption and payload; no text is lost."""
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("own"))
    pages = whole.select("doc_id", "own", media.page_of(F.col("own"), F.sha2(F.col("own").cast("binary"), 256), F.lit("c")).alias("html"))
    for r in pages.collect():
        items = media.parse(r["html"])
        lines = [" ".join(x.split()) for x in r["own"].split("\n")]
        digest = hashlib.sha256(r["own"].encode()).hexdigest()
        want = [*([(lines[0], None, None)] if lines[0] else []), (None, digest, "c"), *((x, None, None) for x in lines[1:] if x)]
        assert [(x["text"], x["digest"], x["caption"]) for x in items] == want
        assert [x["position"] for x in items] == list(range(len(items)))


def test_media_of_unclosed_markup():
    """A head or template without an end tag loses nothing; media in noscript count."""
    page = media.parse("<html><head><title>x</title><body><p>hello <img src=a>")
    assert [(x["kind"], x["text"], x["digest"]) for x in page] == [("text", "hello", None), ("img", None, "a")]
    assert [x["text"] for x in media.parse("<head><title>x</title><meta a=b>plain text")] == ["plain text"]
    assert [x["text"] for x in media.parse("<head><style>p {}</style><script>var x</script></head><p>a")] == ["a"]
    assert [x["digest"] for x in media.parse("<p><noscript><img src=lazy></noscript><img src=b>")] == ["lazy", "b"]
    assert [x["text"] or x["digest"] for x in media.parse("<p>a</p><template><p>b<img src=c>")] == ["a", "b", "c"]
    assert [x["text"] for x in media.parse("<p>a</p><template><p>b</template><p>c")] == ["a", "c"]


def test_media_pages_against_brute_force(spark):
    """The pages' texts by regular expressions over the known markup, in order."""
    import html as markup

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.sub(r"(?s)<head.*?</head>|<!--.*?-->", "", r["html"] or "")
        parts = re.split(r"</?(?:html|body|nav|ul|li|div|article|h1|p|br|footer)\b[^>]*>|<!DOCTYPE[^>]*>", body)
        texts = [x for x in (" ".join(markup.unescape(re.sub(r"</?(?:a|b)\b[^>]*>", "", x)).split()) for x in parts) if x]
        want[r["page_id"]] = (len(texts), 0, sum(map(len, texts)), hashlib.sha256("\n".join(texts).encode()).hexdigest())
    got = {r["page_id"]: tuple(r)[1:] for r in media.media_pages(spark, sf).collect()}
    assert got == want


def plain_fingerprint(t: str, size: int) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    own = [" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_fingerprints(docs, spark):
    want = sorted(repr((i, plain_fingerprint(t or "", 4))) for i, t in corpus() if len(t or "") < 20_000)
    got = [(r["doc_id"], r["fp"] % 2**64) for r in simhash.fingerprints(docs.filter("text is null or length(text) < 20000")).collect()]
    assert sorted(map(repr, got)) == want
    word = spark.createDataFrame([("river",)], "x string").select(F.xxhash64("x").alias("h")).first()["h"]
    assert simhash.fingerprint(b"river") == word % 2**64


@pytest.mark.parametrize(("block", "bits"), [(2048, 4), (16, 4), (2048, 6)])
def test_simhash_groups(spark, monkeypatch, block, bits):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = [rng.getrandbits(64) for _ in range(200)] + [0] * 20
    for c in centres:
        for _ in range(rng.randint(1, 60)):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    rng.shuffle(fps)
    n = len(fps)
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    arr = np.array(fps, np.uint64)
    for i in range(n):
        for j in (np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= bits) + i + 1).tolist():
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.groups(common.stored(df), max_bits=bits).collect()}
    assert got == {i: root(i) for i in range(n)}
    assert simhash.groups(df.limit(0)).count() == 0


def test_simhash_key_goes_on_after_whole_blocks(monkeypatch):
    """A key that fills the buffer with whole blocks and goes on is dealt out to its end."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "HELD", 512)
    fps = np.arange(1, 1035, dtype=np.int64) << 20
    for sizes in ((512, 512, 10), (512, 522)):
        at = np.cumsum((0, *sizes))
        batches = [pa.RecordBatch.from_arrays([pa.array([5] * (b - a), pa.int64()), pa.array(fps[a:b])], ["key", "fp"]) for a, b in zip(at, at[1:])]
        made = [r for b in simhash._candidates(simhash.Ring(4))(iter(batches)) for r in b.to_pylist() if r["members"] is not None]
        assert sorted(r["block"] for r in made) == list(range(len(made)))
        assert sorted(x for r in made for x in np.frombuffer(r["members"], np.int64).tolist()) == fps.tolist()


@pytest.mark.parametrize("kwargs", [{"max_bits": 4}, {"max_bits": 6}, {"max_bits": 4, "chain": 8}, {"max_bits": 9, "words": 2, "segments": 16}])
def test_ring_finds_every_near_pair(kwargs):
    """Of any two fingerprints within the radius, a key that both have keeps to the budgets of its chain."""
    rng = random.Random(3)
    ring = simhash.Ring(**kwargs)
    bits = 64 * ring.words
    for _ in range(2000):
        diff = sum(1 << b for b in rng.sample(range(bits), rng.randint(0, kwargs["max_bits"])))
        met = [n for n, m in enumerate(ring.masks) if not diff & m]
        rows = np.array([ring.split(diff)] * len(met), np.uint64).reshape(len(met), ring.words)
        assert len(ring.near(rows, np.zeros_like(rows), np.array(met, np.int64)))
    far = np.array([ring.split((1 << bits) - 1)], np.uint64)
    assert not len(ring.near(far, np.zeros_like(far), np.array([0])))


def test_alike_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 60 - k, replace=False), rng.integers(0, 2**64, k, dtype=np.uint64)))) for k in (0, 1, 2, 5, 6, 7, 12, 30)]
    sets += [base[:48], base[:47], np.zeros(0, np.uint64), np.zeros(0, np.uint64)]

    def like(a, b):
        return 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))

    want = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if like(sets[i], sets[j])]
    assert list(zip(*(x.tolist() for x in simhash.alike_pairs(sets, None, 0.8)))) == want and want
    across = [(i, j) for i in range(5) for j in range(7) if like(sets[i], sets[5 + j])]
    assert list(zip(*(x.tolist() for x in simhash.alike_pairs(sets[:5], sets[5:], 0.8)))) == across


@pytest.mark.parametrize(("sets", "block"), [(512, 2048), (4, 4)])
def test_alike_groups(spark, docs, empty, monkeypatch, sets, block):
    """One large group of near copies, unlike texts, copies and odd rows: all links of a group are exact, in one block or many."""
    monkeypatch.setattr(simhash, "SETS", sets)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for _ in range(60):
        own = list(base)
        for _ in range(rng.randint(0, 8)):
            own[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [" ".join(f"x{rng.randrange(4000)}" for _ in range(40)) for _ in range(30)] + ["", None, " \n", "one", "one", texts[0].upper()]
    rows = [*enumerate(texts), (None, texts[3]), (None, None), (5, "some other text"), (5, texts[5])]
    plain = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])]
    for i, j in pairs:
        a, b = root(i), root(j)
        up[max(a, b)] = min(a, b)
    table = common.stored(spark.createDataFrame(rows, "doc_id long, text string").withColumn("root", F.lit("x")).withColumn("node", F.lit(1)))
    key = {(common.NULL_ID if r["doc_id"] is None else r["doc_id"], r["d"]): r["text"] for r in table.select("doc_id", "text", common.key_columns()[1].alias("d")).collect()}
    got: dict = {}
    for r in simhash.alike_groups(table).collect():
        i = r["id"]
        got.setdefault(r["root"], []).append((None if i == common.NULL_ID else i, key[i, r["digest"]]))
    want: dict = {}
    for n, row in enumerate(rows):
        want.setdefault(root(n), []).append(row)
    assert sorted(sorted(map(repr, g)) for g in got.values()) == sorted(sorted(map(repr, g)) for g in want.values())
    assert simhash.alike_groups(empty).count() == 0


def test_simhash_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7)], "doc_id long, text string, fp long, root long, best long")
    made = common.stored(simhash.fingerprints(df))
    assert simhash.groups(made.withColumns({"best": F.lit(1), "rank_id": F.lit(1), "least": F.lit(2)})).columns == ["doc_id", "fp", "component_id"]


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def test_quality_model(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = text(rng, rng.randint(20, 80))
        rows.append((i, " ".join(w + "***" for w in t.split()) if bad else t))
        labels.append((i, 0 if bad else 1))
    docs = spark.createDataFrame([*rows, (None, "x"), (9999, None), (9998, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (777_777, 1)], "doc_id long, quality int")
    model = quality.train(docs, known)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 603
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(labels[i][1]) for i in held]) > 0.95
    assert quality.score(empty, model).count() == 0
    nothing = quality.train(empty, known.limit(0))
    assert 0 < quality.score(docs, nothing).first()["score"] < 1


def plain_features(t: str) -> list[float]:
    """The features by plain counting, in the order of quality.NAMES."""
    import math

    raw = t.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(quality.NAMES)
    letters, upper = sum(chr(b).isalpha() and b < 128 for b in raw), sum(65 <= b <= 90 for b in raw)
    counted = [letters, upper, sum(48 <= b <= 57 for b in raw), sum(b in (9, 11, 12, 13, 32) for b in raw), raw.count(10), sum(b in b".,;:?'\"()-" for b in raw), sum(b in b"!#$%&*+/<=>@[\\]^_`{|}~" for b in raw), sum(b >= 128 for b in raw)]
    words = raw.split()
    by = {w: words.count(w) for w in set(words)}
    runs, longest = 1, 1
    for a, b in zip(words, words[1:]):
        runs = runs + 1 if a == b else 1
        longest = max(longest, runs)
    some = max(1, len(words))
    lines = raw.split(b"\n") if not raw.endswith(b"\n") else raw[:-1].split(b"\n")
    whole = [x + b"\n" for x in lines[:-1]] + [lines[-1] + (b"\n" if raw.endswith(b"\n") else b"")]
    k = raw.count(10) + 1
    entropy = -sum(c / n * math.log2(c / n) for c in (raw.count(b) for b in set(raw)))
    return [
        math.log1p(n), *(c / n for c in counted), raw.count(b"|") / n, math.log1p(len(words)) if words else 0.0, sum(map(len, words)) / some, len(by) / some, sum(a == b for a, b in zip(words, words[1:])) / some,
        math.log1p(longest) if words else 0.0, max(by.values(), default=0) / some, sum(w[-1] in b"!#$%&*+/<=>@[\\]^_`{|}~" for w in words) / some, n / k, len(set(whole)) / k, entropy,
    ]


def test_quality_against_brute_force(spark):
    """Features by plain counting and scores by adding the tables up one by one, for the corpus and odd texts."""
    import math

    texts = [t or "" for _, t in corpus()] + ["\n", "a\n", "a\n\na\n", "x x x y y", "|a| *b* c!", "A1 B2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(len(t) % 3 > 0)) for i, t in enumerate(texts)], "doc_id long, quality int")
    x = quality.text_features(*common.flat_text(pa.array(texts)))
    assert np.allclose(x, np.array([plain_features(t) for t in texts]), rtol=2e-4, atol=2e-5)
    model = quality.train(df, labels)

    def score(row):
        bins = [sum(e <= v for e in edges) for edges, v in zip(model.edges, row)]
        total = model.bias + sum(model.single[j][b] for j, b in enumerate(bins)) + sum(model.double[k][bins[i]][bins[j]] for k, (i, j) in enumerate(model.pairs))
        return 1 / (1 + math.exp(-total))

    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    assert all(abs(got[i] - score(x[i])) < 1e-9 for i in got) and len(got) == len(texts) and len({round(s, 6) for s in got.values()}) > 5


def test_quality_repeats_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c", "en"), (1, "a b c", "fr"), (2, "long " * 300_000, "en"), (3, None, "en")], "doc_id long, text string, score string")
    model = quality.train(df, spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    got = [r["score"] for r in quality.score(df, model).orderBy("doc_id").collect()]
    assert len(got) == 4 and got[0] == got[1]
    with pytest.raises(ValueError, match="score"):
        quality.score(df, model, carry=["doc_id", "score"])
    again = quality.train(df.repartition(3), spark.createDataFrame([(1, 1), (1, 0), (2, 0)], "doc_id long, quality int"))
    assert (again.single == model.single).all()
    other = quality.train(df.withColumnRenamed("text", "body"), spark.createDataFrame([(2, 0)], "doc_id long, quality int"), text_col="body")
    assert other.bias < 0


def test_clashing_names_are_errors(spark, docs):
    for call in (
        lambda: lines.drop_repeated_lines(docs.withColumnRenamed("lang", "kept"), carry=["kept"]), lambda: suffixes.remove_repeats(docs.withColumnRenamed("lang", "N_SPANS"), carry=["N_SPANS"]),
        lambda: bpe.encode(docs.withColumnRenamed("doc_id", "ids"), id_col="ids"), lambda: packing.pack(packing.pieces(docs).withColumn("offset", F.lit(1))), lambda: urls.judge(docs.withColumnRenamed("doc_id", "rule"), id_col="rule", url_col="text"),
        lambda: winnow.fingerprint(docs.withColumnRenamed("doc_id", "places"), id_col="places"), lambda: media.interleave(docs.withColumnRenamed("doc_id", "items"), id_col="items", html_col="text"),
    ):
        with pytest.raises(ValueError, match="names of results"):
            call()


def test_lines_filters_grow(spark, monkeypatch):
    """More heavy lines than a filter was made for: it is made anew from the counts, and results stay those of one build."""
    monkeypatch.setattr(lines, "SHARD_LINES", 64)

    def table(a, b):
        rows = [(i, 0, "\n".join(f"line number {j} of a text that is long enough" for j in range(a, b)).encode()) for i in range(a * 10, a * 10 + 4)]
        return spark.createDataFrame(rows, "id long, digest long, text binary")

    old, new = table(0, 40), table(40, 900)
    grown, whole = lines.insert(lines.build(old), new), lines.build(old.union(new))

    def dropped(s):
        return sorted((r["id"], sorted(map(tuple, r["keys"]))) for r in lines.dropped_lines(s).collect())

    assert dropped(grown) == dropped(whole)
    assert all(len(lines.CuckooFilter.from_bytes(r["filter"]).stash) < 20 for r in grown.filters.collect())
    back = lines.delete(grown, new)
    assert dropped(back) == dropped(lines.build(old))


def test_quality_features_of_odd_texts():
    import pyarrow as pa

    data, offsets = common.flat_text(pa.array(["", None, " ", "a", "a a a", "\n\n", "é", "x" * 1000]))
    x = quality.text_features(data, offsets)
    assert x.shape == (8, len(quality.NAMES)) and np.isfinite(x).all()
    alone = [quality.text_features(*common.flat_text(pa.array([t])))[0] for t in ["", "", " ", "a", "a a a", "\n\n", "é", "x" * 1000]]
    assert np.allclose(x, np.array(alone))
