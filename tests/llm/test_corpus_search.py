"""Substring dedup, ranked search and importance resampling on small tables against brute force, and whole-table leaks."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from antecede.llm import decontaminate, exact_dedup, importance, language, lexical_search, line_dedup, quality, secret_scan, suffix_dedup, warc

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, score double, row string, rank int, bytes string, line string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FILL = " ".join(f"w{k % 97}x{k % 31}" for k in range(600))
LONG = " ".join(f"v{k * k % 7919} é{k % 13}" for k in range(30_000))
TEXTS = [
    None, "", " \n\t", "one", "ONE", "the green city\nof Oz", "The Green\nCity of\n\nOz", FILL, FILL.upper(), FILL[:700] + " a\nchange " + FILL[650:], FILL + " end",
    LONG, "é ß ü É\nSS é ß", "x" * 5000, "ab" * 300 + "c", FILL[50:149], FILL[50:150], "Oz " * 40, "\n".join(FILL.split()), "one\ntwo\nthree four\nfive",
]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, "r", 1, "b", "l") for i, t in enumerate(TEXTS)]
    rows += [rows[7], rows[17], rows[1], (None, "the city of Oz", None, None, None, None, None), (2, "green city of the far land", 0.1, "", 2, "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- substring dedup ---------------------------------------------------------------------------


def plain_substrings(rows, depth):
    """(doc_id, n_bytes, n_removed, n_spans, digest) by a dictionary of all strings."""
    seen, out = set(), []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - depth + 1):
            if data[p : p + depth] in seen:
                gone[p : p + depth] = True
            seen.add(data[p : p + depth])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("depth, limit", [(100, 5000), (100, 1), (64, 5000)])
def test_substring_dedup_equals_brute_force(docs, nothing, depth, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id != 2]  # rows equal in doc_id alone: below
    got = suffix_dedup.digests(suffix_dedup.substring_dedup(docs.where("doc_id IS NULL OR doc_id <> 2"), depth, block_rows=40, bucket_limit=limit)).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == set(plain_substrings(rows, depth))
    assert suffix_dedup.substring_dedup(nothing).count() == 0


def test_substring_dedup_of_one_id_with_two_texts_and_wrong_depth(spark, docs):
    df = spark.createDataFrame([(2, FILL), (2, FILL + "z"), (1, FILL[:90])], "doc_id bigint, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.substring_dedup(df).collect())
    assert got in ([(90, 0), (len(FILL), 0), (len(FILL) + 1, len(FILL))], [(90, 0), (len(FILL), len(FILL)), (len(FILL) + 1, 0)])
    with pytest.raises(ValueError):
        suffix_dedup.substring_dedup(docs, 30)


def test_substring_dedup_of_random_small_alphabets(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(120):
        parts = ["".join(rng.choice(list("ab"), int(rng.integers(1, 200)))) for _ in range(2)]
        shared = rows[int(rng.integers(len(rows)))][1] if rows else ""
        at = int(rng.integers(len(shared) + 1))
        rows.append((i, parts[0] + shared[at : at + 160] + parts[1] + parts[0][-120:]))
    got = suffix_dedup.digests(suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), block_rows=60)).collect()
    assert {tuple(r) for r in got} == set(plain_substrings(rows, 100))


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    data[300:600] = data[:300]  # ties far longer than the period
    wanted = np.arange(0, 780)
    rank = suffix_dedup.suffix_ranks(data, wanted, 100)
    strings = [data[w : w + 100].tobytes() for w in wanted]
    order = sorted(range(len(wanted)), key=lambda k: (rank[k], k))
    assert [strings[k] for k in order] == sorted(strings)


def test_long_documents_are_read_in_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WINDOW", 64)
    rows = [(1, FILL), (2, "other " + FILL[300:1200] + " other")]
    got = suffix_dedup.digests(suffix_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert {tuple(r) for r in got} == set(plain_substrings(rows, 100))


# --- ranked search -----------------------------------------------------------------------------


def plain_search(docs, items, k):
    held = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    N, L = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys((i, t) for i, t in items if t is not None):
        scores = []
        for d, c in held:
            n = sum(c.values())
            m = 100 - 90 + (90 * n * N) // L
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if c[t]
            )
            scores.append((-score, d is not None, d or 0, d))
        best = [x for x in sorted(scores) if x[0] < 0][:k]
        out += [(item, rank + 1, d, -score) for rank, (score, _, _, d) in enumerate(best)]
    return out


def test_search_equals_brute_force(spark, docs, nothing):
    items = [(0, "the green city of Oz"), (0, "the green city of Oz"), (1, None), (2, ""), (3, "nowhere found"), (4, "é"), (5, FILL[:400]), (6, "ONE two"), (7, "one TWO"), (8, LONG[:2000])]
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, rank int, score bigint")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], items, 10)
    for size in (4 << 20, 300):
        got = [tuple(r) for r in lexical_search.rank_documents(docs, bench, part_bytes=size).select("item_id", "rank", "doc_id", "score").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert lexical_search.rank_documents(nothing, bench).count() == 0 and lexical_search.rank_documents(docs, bench.limit(0)).count() == 0


def test_search_over_many_blocks_and_wide_masks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 16)
    rng = np.random.default_rng(9)
    rows = [(int(i), " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 120)) % 300)) for i in rng.permutation(300)]
    items = [(i, " ".join(f"t{int(x)}" for x in rng.integers(0, 300, size))) for i, size in enumerate((1, 3, 30, 90, 280))]
    df, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [tuple(r) for r in lexical_search.rank_documents(df, bench).collect()]
    assert sorted(got) == sorted(plain_search(rows, items, 10)) and len(got) == 50


def test_groups_have_one_mask_each_and_most_are_not_scored(monkeypatch):
    rng = np.random.default_rng(10)
    docs, terms = 400, 130
    held = rng.random((docs, terms)) < rng.random(terms) * 0.7
    owner, term = np.nonzero(held)
    block = lexical_search.Block(np.arange(docs), owner, term, rng.integers(1, 1000, len(owner)))
    rows = block.rows(np.arange(terms))
    group, present = block.groups(rows)
    assert (present[:, group].T.astype(bool) == held[:, block.terms[rows]]).all()
    few = block.rows(np.arange(5))
    group, present = block.groups(few)
    assert present.shape[1] == len({tuple(r) for r in held[:, :5]})
    scored, plain = [], lexical_search.Block.score
    monkeypatch.setattr(lexical_search.Block, "score", lambda self, r, d: scored.append(len(d)) or plain(self, r, d))
    block.best(np.arange(5), 10, np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert sum(scored) < docs


# --- importance resampling ---------------------------------------------------------------------


def plain_resample(docs, target, percent, least, buckets, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(text):
        w = word.findall(lower(text))
        return w, [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    own, wanted = [(d, *features(t)) for d, t in docs], Counter(b for t in target for b in features(t)[1])
    s = Counter(b for _, _, f in own for b in f)
    S, T = sum(s.values()), sum(wanted.values())
    out = []
    for d, w, f in own:
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    drawn = Counter()
    for rank, x in enumerate(able[: percent * len(able) // 100]):
        drawn[(*x[:4], rank + 1)] += 1
    rest = Counter(x[:4] for x in out) - Counter(k[:4] for k in drawn.elements())
    return drawn + Counter({(*k, None): n for k, n in rest.items()})


@pytest.mark.parametrize("percent, least, buckets", [(50, 2, 10_000), (5, 20, 10_000), (100, 0, 7)])
def test_resampling_equals_brute_force(spark, docs, nothing, percent, least, buckets):
    target = spark.createDataFrame([("The green city\nof Oz", 1), (None, 2), ("", 3), (FILL[:90], 4), (FILL[:90], 4)], "text string, weight int")
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], percent, least, buckets, 42)
    got = Counter(tuple(r) for r in importance.resample(docs, target, percent, least, buckets).collect())
    assert got == want
    assert importance.resample(nothing, target).count() == 0
    empty = importance.resample(docs, target.limit(0), percent, least, buckets)
    assert Counter(tuple(r) for r in empty.collect()) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [], percent, least, buckets, 42)


def test_runs_inside_and_across_lines_are_all_runs():
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bb", "é", " ", "  ", "\n", "\n", ".", "7"], int(rng.integers(0, 40)))).encode()
        words = importance.WORD.findall(text)
        lines = text.split(b"\n")
        inside = [h for x in lines for h in importance.hashes(importance.WORD.findall(x))]
        assert Counter(inside + importance.crossing(lines)) == Counter(importance.hashes(words))
        assert Counter(importance.hashes(words)) == Counter(zlib.crc32(b" ".join(words[k : k + n])) for n in (1, 2, 3) for k in range(len(words) - n + 1))


# --- earlier operators -------------------------------------------------------------------------


def test_leaks_of_all_documents_equal_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r.item_id, next(decontaminate.text_words([r.text]))) for r in bench.collect()]
    items = [(i, *decontaminate.parts_of(h, a, decontaminate.SEGMENT)[:2]) for i, (h, a) in items]
    want = set()
    for r in docs.collect():
        text, whole = next(decontaminate.text_words([r.text or ""]))[0], {}
        for i, question, answer in items:
            if decontaminate.overlap(question, whole, text) >= 0.8 and decontaminate.overlap(answer, whole, text) >= 0.8:
                want.add((r.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == want and len(want) >= 3


def test_line_dedup_is_linear_in_the_lines_of_a_document(spark):
    seconds = []
    for lines in (1_000, 10_000, 10_000):  # the first run also compiles
        rows = [(d, "\n".join(f"line {k} of {d if k % 50 == 0 else 'all'}" for k in range(lines))) for d in range(3)]
        start = time.time()
        got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        seconds.append(time.time() - start)
        assert sorted(r.removed_lines > 0.9 * lines for r in got) == [False, True, True]
    assert seconds[-1] < 60


def test_digest_index_is_reopened_by_its_location(spark, tmp_path):
    location = str(tmp_path / "index")
    texts = lambda *rows: exact_dedup.digests(spark.createDataFrame(rows, "doc_id bigint, text string"))
    index = exact_dedup.DigestIndex(spark, "index_one", location, buckets=4)
    index.add(texts((1, "a"), (2, "b")))
    spark.sql("DROP TABLE index_one")  # what a new session with a catalog of its own sees
    again = exact_dedup.DigestIndex(spark, "index_one", location, buckets=16)
    assert again.buckets == 4
    again.add(texts((3, "a"), (4, "c")))
    assert sorted(r.keep_id for r in again.read().collect()) == [1, 2, 4]
    other = exact_dedup.DigestIndex(spark, "another_name", location)
    other.add(texts((5, "c"), (6, "d")))
    assert sorted(r.keep_id for r in other.read().collect()) == [1, 2, 4, 6]
    plan = other.read().hint("merge").join(texts((7, "d")), "text_sha256")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    spark.range(3).write.parquet(str(tmp_path / "foreign"))
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, "foreign", str(tmp_path / "foreign"))
    spark.sql("DROP TABLE index_one")
    spark.sql("DROP TABLE another_name")


def test_dictionaries_learn_more_than_openings(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(200):
        name = ["x1", "x2"][i % 2]
        parts = {"x1": "ka lo mi ru te".split(), "x2": "brin skal vorn dreg holm".split()}[name]
        body = " ".join("".join(rng.choice(parts, 2)) for _ in range(300))
        rows.append((i, "This text is free to use and comes without any warranty whatever. " * 20 + body, name))
    learned = language.dictionaries(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for name, stem in (("x1", b"mi"), ("x2", b"skal")):
        assert learned[name].count(stem) > 100 and len(learned[name]) <= language.DICTIONARY
    got = language.classify(spark.createDataFrame([(1, "kalo miru teka lomi rute"), (2, "brinskal vorndreg holmbrin")], "doc_id bigint, text string"), learned)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "x1", 2: "x2"}


def test_token_spans_of_whole_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = [(-1, "key QwZkXvBnMtRpLsHdGfJcYwTq end"), (-2, "plain " + "understanding" * 3), (-3, "=" * 60), (-4, "d41d8cd98f00b204e9800998ecf8427e"), (-5, None)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + extra
    coder = secret_scan.encoding(secret_scan.VOCABULARY)
    run = re.compile(r"[A-Za-z0-9+/_=-]+")
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))).collect()}
    for doc_id, text in rows:
        text, want = text or "", []
        base = secret_scan.base_spans(text)
        for m in run.finditer(text):
            known = secret_scan.DIGEST.fullmatch(m[0]) or secret_scan.UUID.fullmatch(m[0])
            if len(m[0]) >= 20 and not known and not any(a < m.end() and m.start() < b for a, _, b in base) and len(m[0]) < 2.0 * len(coder.encode_ordinary(m[0])):
                want.append(f"token:{m.start()}:{m.end()}")
        assert [s for s in got[doc_id].spans.split(",") if s.startswith("token")] == want
    assert got[-1].n_token == 1 and [got[k].n_token for k in (-2, -3, -4, -5)] == [0, 0, 0, 0]


# --- stages of the pipeline ----------------------------------------------------------------------

CLASHING = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, taken string, row string, going bigint, left string, target double, "
    "text_key string, component_id bigint, kept boolean, score string, `_size` int, blocks string"
)


@pytest.mark.parametrize("place", range(5))
def test_stages_with_nulls_ties_repeats_and_clashing_names(spark, place, tmp_path):
    name, function = corpus_pipeline.STAGES[place]
    passage = "\n".join(" ".join(f"shared{k}word{j}" for j in range(30)) for k in range(4))
    texts = [None, "", " \n", "one word", FILL, FILL, FILL + " tail", f"a\n{passage}\nb", f"c\n{passage}\nd", LONG]
    rows = [(i, t, ["en", None][i % 2], [None, "a", "b"][i % 3], len(t or ""), 7, "t", "r", 9, "l", 1.5, "k", 3, None, "s", 4, "b") for i, t in enumerate(texts)]
    rows += [rows[4], (None, "text of no id", None, None, None, *rows[0][5:])]
    docs = spark.createDataFrame(rows, CLASHING)
    function(spark, docs, FOLDER).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns[: len(docs.columns)] == docs.columns and (place == 4 or out.columns == docs.columns)
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    if name == "near dedup":
        assert ids == Counter([0, 1, 2, 3, 4, 4, 7, 9, None])  # 5 and 6 are copies of 4, 8 of 7; rows of one id stay together
    elif name == "mixing":
        assert {"mix_size", "mix_taken", "mix_target", "mix_blocks", "source_size"} <= set(out.columns) and 9 in ids and not {0, 1, 2} & set(ids)
        assert all(r.size == 7 and r.taken == "t" and 0 < r.mix_taken <= 2 * r.mix_size for r in got)
    else:
        assert ids == Counter(r[0] for r in rows)
    if name == "line dedup":
        by_id = {r.doc_id: r for r in got}
        assert by_id[8].text == "c\nd" and by_id[8].n_chars == 3 and by_id[7].text == texts[7] and by_id[0].text is None
    assert all(r.left == "l" and r["_size"] == 4 and r.row == "r" for r in got)
    nothing = function(spark, docs.limit(0), FOLDER)
    assert nothing.count() == 0 and nothing.columns[: len(docs.columns)] == docs.columns


def test_archives_are_parsed_in_pieces():
    import gzip

    records = [b"WARC/1.1\r\nX: %d\r\nContent-Length: %d\r\n\r\n" % (k, n) + bytes([65 + k % 26]) * n + b"\r\n\r\n" for k, n in enumerate((0, 5, 70_000, 1, 3_000_000))]
    for content in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        got = [(f["X"], len(b)) for f, b in warc.parse_warc(content)]
        assert got == [("0", 0), ("1", 5), ("2", 70_000), ("3", 1), ("4", 3_000_000)]
    assert b"".join(warc.inflated(gzip.compress(records[2]), 100)) == records[2]
    with pytest.raises(ValueError):
        list(warc.parse_warc(records[1][:-8]))


# --- whole queries of the classifiers, document by document ------------------------------------------


def test_quality_scores_equal_a_plain_sum_over_features(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    sample = quality.labelled_sample(docs, labels, "quality", quality.PARTS, quality.FOLD, quality.FIT_ROWS)
    weights = quality.fit(sample).astype(float)
    run, seen, mask = re.compile(rb"[0-9]+|[a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0D]+"), {}, (1 << 64) - 1

    def mix(x):
        x ^= x >> 33
        x = x * 0xFF51AFD7ED558CCD & mask
        x ^= x >> 29
        x = x * 0xC4CEB9FE1A85EC53 & mask
        return x ^ x >> 32

    def word_hash(word):
        if word not in seen:
            total = sum((b + 1) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word))
            seen[word] = mix((total + len(word) * 0xD6E8FEB86659FD93) & mask)
        return seen[word]

    def plain(text):
        words = run.findall((text or "").encode().lower())
        hashed = [int(quality.REPEATED) if k and w == words[k - 1] else word_hash(w) for k, w in enumerate(words)]
        keys = [mix(h) for h in hashed]
        keys += [mix((a * 0x9FB21C651E98DF25 + (b ^ b >> 31)) & mask) for a, b in zip(hashed, hashed[1:])]
        counts = Counter(k >> (64 - quality.BITS) for k in keys)
        norm = math.sqrt(sum((1 + math.log(n)) ** 2 for n in counts.values()))
        return 1 / (1 + math.exp(-(weights[-1] + sum(weights[k] * (1 + math.log(n)) / norm for k, n in counts.items()))))

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.score == pytest.approx(plain(texts[r.doc_id]), abs=1e-5) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_languages_equal_the_smallest_coding_document_by_document(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    learned = sorted(language.dictionaries(docs).items())
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {r.lang_pred for r in got.values()} <= {name for name, _ in learned} | {"und"}
    held = [r for r in docs.collect() if got[r.doc_id].held_out and r.lang is not None and got[r.doc_id].lang_pred != "und"]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held) > 20
    for r in docs.collect():
        text = r.text or ""
        if not any(map(str.isalpha, text)):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        raw = text.encode().lower()
        raw = raw if len(raw) >= language.SHORT else (raw + b" ") * (language.SHORT // (len(raw) + 1) + 1)
        sizes = []
        for _, content in learned:
            options = zstandard.ZstdCompressionParameters.from_level(
                language.LEVEL, min_match=language.SHORTEST_MATCH, dict_size=len(content), source_size=language.BLOCK, write_checksum=0, write_content_size=0, write_dict_id=0
            )
            coder = zstandard.ZstdCompressor(compression_params=options, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            sizes.append(sum(len(coder.compress(raw[k : k + language.BLOCK])) for k in range(0, len(raw), language.BLOCK)))
        assert got[r.doc_id].lang_pred == learned[sizes.index(min(sizes))][0]
        first, second = sorted(sizes)[:2]
        assert got[r.doc_id].score == pytest.approx((second - first) / second)
