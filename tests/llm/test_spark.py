"""The operators on Spark: every query against a plain definition, and odd tables."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from countloom.llm import (
    common,
    compact_windows,
    components,
    crf_toxicity,
    ftrl_quality,
    license_rules,
    merge_replay,
    positional_index,
    quality_rules,
    registry,
    simhash,
    template_html,
    tput_search,
    trie_bpe,
    unigram_trie,
    whitening,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeghiklmnoprstu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use inside."""
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, prose(1, 60)), (5, prose(1, 60)), (6, prose(1, 60)), (7, prose(2, 40000)), (8, "same same same same same same " * 30), (None, prose(3, 50)), (9, "a\n\nb\n a\nb\nb")]
    rows = [(i, t, None, "s", None if t is None else len(t), "x", 1, 2) for i, t in rows]
    return spark.createDataFrame(rows, SCHEMA + ", fp string, key int, n_repeat_words int")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 1, 1), (5, 0, 0), (8, 0, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, prose(1, 30)), (2, "one"), (3, None), (4, ""), (None, "same"), (1, prose(9, 12))], "item_id bigint, text string")


def test_all_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))


# each query, whole table


class Article(HTMLParser):
    """The article's blocks by another parser, for pages whose only blocks are h1 and p."""

    def __init__(self):
        super().__init__()
        self.parts, self.on = [[]], False

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.on = True
        if tag in ("h1", "p", "article"):
            self.parts.append([])
        if tag == "br":
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.parts.append([])
        if tag == "article":
            self.on = False

    def handle_data(self, data):
        if self.on:
            self.parts[-1].append(data)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])  # at sf0.1 hosts have enough pages for templates
def test_op1(spark, sf_dir, size):
    sf_dir = sf_dir.replace("sf0.001", size)
    pages = pd.read_parquet(f"{sf_dir}/pages.parquet").set_index("page_id")
    got = registry.op1_template_html(spark, sf_dir).toPandas()
    assert sorted(got.page_id) == sorted(pages.index) and (got.n_chars == got.text.str.len()).all()
    for row in got.itertuples():
        parser = Article()
        parser.feed(pages.html[row.page_id])
        blocks = (re.sub(r"\s+", " ", "".join(p)).strip() for p in parser.parts)
        assert row.text == "\n\n".join(b for b in blocks if b)


def test_op2(spark, sf_dir, docs):
    got = registry.op2_unigram_trie(spark, sf_dir).toPandas().set_index("doc_id")
    pieces = unigram_trie.vocabulary(PIECES)
    often, counts = Counter(w for t in docs.text for w in t.split()), Counter()
    prior = unigram_trie.scores_of(pieces, {})
    known, lowest = set(pieces), min(prior.values()) - 1
    for w, n in often.items():
        for p in best_pieces(w, prior, lowest):
            counts[p] += n if p in known else 0
    ranks = {p: r for r, p in enumerate(pieces)}
    scores = unigram_trie.scores_of(pieces, {ranks[p]: n for p, n in counts.items() if n})
    assert unigram_trie.piece_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), PIECES) == {ranks[p]: n for p, n in counts.items() if n}
    lengths = {w: len(best_pieces(w, scores, min(scores.values()) - 1)) for w in often}
    assert [tuple(got.loc[i, ["n_pretokens", "n_tokens"]]) for i in docs.doc_id] == [(len(t.split()), sum(lengths[w] for w in t.split())) for t in docs.text]


def best_pieces(word, scores, byte_score):
    """The likeliest cut of a word, of equal ones the one with fewer pieces; a byte outside the vocabulary is None."""
    word = unigram_trie.MARK + word
    best = [(0.0, 0, [])]
    for n in range(1, len(word) + 1):
        width = len(word[n - 1].encode())
        s, k, cut = best[n - 1]
        options = [(s + width * byte_score, -k - width, cut + [None] * width)]
        for start in range(max(0, n - 20), n):
            if word[start:n] in scores:
                s, k, cut = best[start]
                options.append((s + scores[word[start:n]], -k - 1, cut + [word[start:n]]))
        top = max(options, key=lambda o: o[:2])
        best.append((top[0], -top[1], top[2]))
    return best[-1][2]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    want = duck.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got) == sorted(want) and len(got)
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(got)].values.tolist()))


def test_op5(spark, sf_dir, docs):
    got = registry.op5_ngram_ratio(spark, sf_dir).toPandas().set_index("doc_id")
    good = set(pd.read_parquet(f"{sf_dir}/labels.parquet").query("quality == 1").doc_id)
    import xxhash

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    grams, size = {}, quality_rules.BUCKETS
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in re.findall(r"[^\W_]+|(?:[^\s\w]|_)+", t)]
        grams[i] = [x % size for x in h] + [(((a << 5) ^ b) & (1 << 64) - 1) >> 17 & size - 1 for a, b in zip(h, h[1:], strict=False)]
    raw, target = Counter(g for v in grams.values() for g in v), Counter(g for i, v in grams.items() if i in good for g in v)
    prior = quality_rules.PRIOR
    weight = {g: np.log((target[g] + prior) / (sum(target.values()) + prior * size)) - np.log((raw[g] + prior) / (sum(raw.values()) + prior * size)) for g in raw}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = {j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(repeat) > 20 * len(w)
        row = got.loc[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat), failed)
        score = sum(weight[g] for g in grams[i]) / len(grams[i])
        assert row.score == pytest.approx(score, abs=1e-9) and row.kept == (not failed and score >= quality_rules.THRESHOLD)


def groups(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op6(spark, sf_dir, docs):
    got = registry.op6_simhash_gray_index(spark, sf_dir).toPandas().set_index("doc_id")
    fp = {i: simhash.fingerprint(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    want = groups(pairs, fp)
    assert all(got.fingerprint[i] == f"{fp[i]:016x}" and got.component_id[i] == want[i] for i in fp)


def test_op7(spark, sf_dir, docs):
    got = registry.op7_compact_windows(spark, sf_dir).toPandas().set_index("doc_id")
    words, first, pairs, covered = {i: lower(t).encode().split() for i, t in sorted(zip(docs.doc_id, docs.text, strict=True))}, {}, [], {}
    for i, w in words.items():
        hit, own = set(), []
        for k in range(len(w) - 49):
            gram = tuple(w[k : k + 50])
            if gram in first:
                pairs.append((first[gram], i))
                hit |= set(range(k, k + 50))
            own.append(gram)
        for gram in own:
            first.setdefault(gram, i)
        covered[i] = hit
    classes = groups(pairs, words)
    for i in words:  # near-duplicates may add to what equal passages give, never take away
        spans = {j for s in got.spans[i] for j in range(s["a"], s["b"])}
        assert covered[i] <= spans and got.n_repeat_words[i] == len(spans) and got.n_words[i] == len(words[i])
        assert got.class_id[i] == got.class_id[classes[i]]
        for s in got.spans[i]:
            a, b = (set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (words[i][s["a"] : s["b"]], words[s["rep"]][s["rep_a"] : s["rep_b"]]))
            assert s["rep"] < i and s["b"] - s["a"] >= 50 and len(a & b) / len(a | b) >= 0.8


def test_op8(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    got, library = registry.op8_trie_bpe(spark, sf_dir).toPandas().set_index("doc_id"), Tokenizer.from_file(BPE)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        digests = hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert tuple(got.loc[i]) == (len(ids), *digests)


def windows_of(benchmark):
    found = {}
    for i, t in benchmark:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            found.setdefault(tuple(w[k : k + 10]), set()).add(i)
    return found


def brute_hits(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if (x := tuple(w[k : k + n])) in windows:
                hit |= set(range(k, k + n))
                items |= windows[x]
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)


def test_op9(spark, sf_dir, docs, items, odd, monkeypatch):
    benchmark = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    windows = windows_of(zip(benchmark.item_id, benchmark.text, strict=True))
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = registry.op9_positional_index(spark, sf_dir).toPandas().set_index("doc_id")
    assert all(tuple(got.loc[i, names]) == brute_hits(t, windows) for i, t in zip(docs.doc_id, docs.text, strict=True))
    assert got.contaminated.any()
    near = positional_index.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=3).toPandas()
    assert (near.n_near_items >= near.n_items).all() and near.n_items.sum() == got.n_items.sum()
    # odd rows, then all of it with a benchmark that is joined in small blocks
    windows = windows_of((r.item_id, r.text) for r in items.collect() if r.item_id is not None)
    want = Counter((r.doc_id, *brute_hits(r.text, windows)) for r in odd.collect())
    for part in (odd, odd.repartition(7)):
        rows = positional_index.contamination(part, items).collect()
        assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == want
    assert Counter(r.doc_id for r in positional_index.clean(odd, items).collect()) == Counter(k[0] for k in want.elements() if not k[-1])
    monkeypatch.setattr(positional_index, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(positional_index, "BLOCK_WINDOWS", 500)
    rows = positional_index.contamination(odd, items).collect()
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in rows) == want
    joined = positional_index.contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=3).toPandas()
    assert joined.sort_values("doc_id").reset_index(drop=True).equals(near.sort_values("doc_id").reset_index(drop=True))
    assert Counter(r.doc_id for r in positional_index.clean(odd, items).collect()) == Counter(k[0] for k in want.elements() if not k[-1])


@pytest.mark.parametrize(("name", "label"), [("op3_crf_toxicity", "toxic"), ("op10_ftrl_quality", "quality")])
def test_classifiers(spark, sf_dir, name, label):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    from zlib import crc32

    assert (got.held_out == [crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= (0.5 if label == "toxic" else 0.3))).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
@pytest.mark.parametrize(("name", "label"), [("op3_crf_toxicity", "toxic"), ("op10_ftrl_quality", "quality")])
def test_held_out_quality(spark, sf, name, label):
    folder = Path(f"/root/testdata/{sf}")
    if not folder.exists():
        pytest.skip("no test tables")
    marks = pd.read_parquet(folder / "labels.parquet").groupby("doc_id")[label].max().reset_index()
    both = registry.QUERIES[name](spark, str(folder)).filter("held_out").toPandas().merge(marks, on="doc_id")
    yes, no = (both.score[both[label] == k].to_numpy() for k in (1, 0))
    auc = ((yes[:, None] > no).mean() + (yes[:, None] == no).mean() / 2).item()
    assert auc >= 0.95
    if label == "toxic":
        assert (no >= 0.5).mean() <= 0.02 and (yes >= 0.5).mean() >= 0.9
    else:
        assert (both.predicted == both.quality).mean() >= 0.9


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(400):
        words = prose(i, 30).split()
        if i % 4 == 0:
            words[rng.randrange(30)] = "zzgrumble"
            words[rng.randrange(30)] = "Zzgrumbled"
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks, "doc_id bigint, toxic int")
    got = crf_toxicity.score(docs, crf_toxicity.train(docs, labels)).filter("held_out").collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) and (len(r.spans) > 0) == (r.doc_id % 4 == 0) for r in got)


# odd tables


def test_odd_rows(spark, odd, none, marks, items):
    n = odd.count()
    bpe = trie_bpe.encode(odd, BPE, with_ids=True).collect()
    assert len(bpe) == n and {r.n_tokens for r in bpe if r.doc_id in (1, 2, 3)} == {0} and all(len(r.ids) == r.n_tokens for r in bpe)
    assert {r.decoded_sha256 for r in bpe if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert {r.n_tokens for r in unigram_trie.token_counts(odd, PIECES).collect() if r.doc_id in (1, 2, 3)} == {0}
    assert license_rules.scan(odd).filter("n_sentences > 0").count() == 0
    rules = {r.doc_id: r for r in quality_rules.rules(odd, marks).collect()}
    assert not any(rules[i].kept for i in (1, 2, 3, 4, 8)) and rules[9].n_dup_lines == 2 and rules[7].n_words == 40000 and rules[8].n_repeat_words == 180
    assert quality_rules.keep_good(odd, marks).columns == odd.columns
    near = {r.doc_id: r for r in simhash.near_duplicates(odd).collect()}
    assert near[1].fingerprint == "0" * 16 and near[2].component_id == near[3].component_id == 1 and near[6].component_id == 5
    assert Counter(r.doc_id for r in simhash.without_copies(odd).collect())[5] == 2
    passages = compact_windows.passages(odd).collect()
    assert len(passages) == n and {r.n_repeat_words for r in passages if r.doc_id == 6} == {60}
    assert compact_windows.without_repeats(odd).filter("doc_id = 6").count() == 0
    for scored in (ftrl_quality.score(odd, ftrl_quality.train(odd, marks)), crf_toxicity.score(odd, crf_toxicity.train(odd, marks))):
        assert scored.count() == n and scored.filter("score is null or predicted is null").count() == 0


CLASHES = ["id", "id_", "spans", "copy", "leak", "row", "verdict", "words", "lines", "buckets", "score", "at", "node", "fp", "key", "place", "kind", "rep", "marks", "__text", "__words", "__id", "__spans", "__copy", "__h"]


def test_clashing_names_and_stages(spark, odd, marks, items, sf_dir):
    """Every stage and operator on columns with names that are used inside, which come back as they were."""
    wide = odd.drop("fp", "key", "n_repeat_words").select("*", *(F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    part = spark.createDataFrame([(20, f"{prose(1, 60)} {prose(31, 40)}"), (21, f"{prose(32, 40)} {prose(9, 12)}"), (22, prose(33, 50))], "doc_id bigint, text string")
    wide = wide.unionByName(part, allowMissingColumns=True)
    before = {(r.doc_id, r.text): r.asDict() for r in wide.collect()}
    stages = {
        "rules": quality_rules.keep_good(wide, marks),
        "near": simhash.without_copies(wide),
        "passages": compact_windows.without_repeats(wide),
        "leaks": positional_index.clean(wide, items),
    }
    for name, got in stages.items():
        rows = got.collect()
        assert got.schema.names == wide.schema.names and rows
        for r in rows:
            assert all(r[c] is None or r[c] == f"{c} of {r.doc_id}" for c in CLASHES)
            assert name == "passages" or before[r.doc_id, r.text] == r.asDict()
    assert {r.doc_id for r in stages["leaks"].collect()}.isdisjoint({4, 5, 6, 20, 21})
    assert {r.text for r in stages["passages"].collect() if r.doc_id == 20} == {prose(31, 40)}
    n = wide.count()
    for got in (trie_bpe.encode(wide, BPE), unigram_trie.token_counts(wide, PIECES), license_rules.scan(wide), quality_rules.rules(wide, marks), simhash.near_duplicates(wide), compact_windows.passages(wide), positional_index.contamination(wide, items), ftrl_quality.score(wide, ftrl_quality.train(wide, marks)), crf_toxicity.score(wide, crf_toxicity.train(wide, marks))):
        assert got.count() == n


def test_empty_tables(spark, none, marks, items):
    no_marks, no_items = marks.limit(0), items.limit(0)
    results = [
        trie_bpe.encode(none, BPE), unigram_trie.token_counts(none, PIECES), license_rules.scan(none), quality_rules.rules(none, no_marks), quality_rules.keep_good(none, marks),
        simhash.near_duplicates(none), simhash.without_copies(none), compact_windows.passages(none), compact_windows.without_repeats(none), positional_index.contamination(none, no_items),
        positional_index.clean(none, items), ftrl_quality.score(none, ftrl_quality.train(none, no_marks)), crf_toxicity.score(none, crf_toxicity.train(none, no_marks)),
        template_html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")),
    ]
    assert all(r.count() == 0 for r in results)


def test_without_labels_or_items(spark, odd, marks, items):
    assert quality_rules.rules(odd, marks.limit(0)).filter("kept = base_failed").count() == 0
    assert positional_index.clean(odd, items.limit(0)).count() == odd.count()
    assert ftrl_quality.score(odd, ftrl_quality.train(odd, marks.limit(0))).filter("score <> 0.5").count() == 0


def test_pages(spark):
    shell = "<html><body><div>Hello reader, welcome back to us</div><div class=x><p>{}</p></div><div>Closing words for all of you</div></body></html>"
    rows = [(i, f"http://a.example/{i}", shell.format(prose(i, 30)), i) for i in range(8)]
    rows += [(20 + i, "http://b.example/", shell.format(prose(99, 30)), i) for i in range(8)]  # one page over and over
    rows += [(40, None, "<p>No url</p>", 0), (41, "http://c.example", None, 0), (42, "x", "", 0)]
    got = {r.page_id: r.text for r in template_html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")).collect()}
    assert all(got[i] == prose(i, 30) for i in range(8))
    assert all(got[20 + i].startswith("Hello reader") for i in range(8))
    assert (got[40], got[41], got[42]) == ("No url", "", "")


def test_templates_without_marks(spark, monkeypatch):
    """No classes, no article: what nearly all pages of a host share goes, at any depth; what some of them share stays."""
    plain = "<html><body><div>Hello reader, welcome back</div>{}<div><p>{}</p></div><div>Closing words</div></body></html>"
    section = "<section><h3>Section of the day</h3><p>More of this section</p></section>"
    rows = [(i, f"http://a.example/{i}", plain.format(section if i else "", prose(i, 30))) for i in range(12)]
    # copies of one article under several addresses, which share all but an advert
    article = "<html><body><article><h1>{}</h1><p>{}</p></article><div class=ad>{}</div></body></html>"
    rows += [(100 + i, f"http://b.example/?ref={i}", article.format(prose(50, 4), prose(51, 40), prose(60 + i, 5))) for i in range(6)]
    # a text that each article of the host has inside
    inside = "<html><body><article><h1>{}</h1><p>{}</p><p>Read our letters every week</p></article></body></html>"
    rows += [(200 + i, f"http://c.example/{i}", inside.format(prose(70 + i, 4), prose(80 + i, 40))) for i in range(6)]
    # paragraphs that some pages share, in and outside of a marked article
    shared = [prose(300, 12), prose(301, 12)]
    rows += [(300 + i, f"http://d.example/{i}", inside.replace("Read our letters every week", shared[0] if i % 2 else prose(310 + i, 9)).format(prose(320 + i, 4), prose(330 + i, 20))) for i in range(12)]
    rows += [(400 + i, f"http://e.example/{i}", plain.format(f"<p>{shared[1]}</p>" if i % 3 else "", prose(340 + i, 30))) for i in range(12)]
    # template text deep inside: each level on nearly all pages of the one above
    deep = lambda i, n: f"<div><b>Level {n} of it</b><p>Words of level {n}</p>{deep(i, n + 1) if n < 8 and i >= n // 4 else ''}</div>"
    rows += [(500 + i, f"http://f.example/{i}", plain.format(deep(i, 0), prose(500 + i, 30))) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    more = {300 + i: f"{prose(320 + i, 4)}\n\n{prose(330 + i, 20)}\n\n{shared[0] if i % 2 else prose(310 + i, 9)}" for i in range(12)}
    more |= {400 + i: (f"{shared[1]}\n\n" if i % 3 else "") + prose(340 + i, 30) for i in range(12)} | {500 + i: prose(500 + i, 30) for i in range(30)}
    want = more | {i: prose(i, 30) for i in range(12)} | {100 + i: f"{prose(50, 4)}\n\n{prose(51, 40)}" for i in range(6)} | {200 + i: f"{prose(70 + i, 4)}\n\n{prose(80 + i, 40)}" for i in range(6)}
    assert {r.page_id: r.text for r in template_html.extract(pages).collect()} == want
    monkeypatch.setattr(template_html, "BROADCAST_TOKENS", -1)
    assert {r.page_id: r.text for r in template_html.extract(pages).collect()} == want


def test_boilerplate_names():
    page = '<article><h1>Title here</h1><div class="{}">Not of it</div><p class="{}">Text of it</p></article>'
    for name in ("user-comments", "disqus_thread", "promo-box-large", "commentList", "sticky newsletter-wide", "site-footer"):
        assert template_html.main_text(page.format(name, "lead")) == "Title here\n\nText of it", name
    for name in ("copyright-law", "comments-open", "with-sidebar", "has-menu", "content-with-sidebar", "adventure", "menus-of-the-past"):
        assert template_html.main_text(page.format("ad", name)) == "Title here\n\nText of it", name


def test_op7_is_the_same_for_all_batchings(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    setting, results = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(setting)
    try:
        for parts, rows in ((1, 1999), (7, 10), (4, 90)):
            spark.conf.set(setting, str(rows))
            results.append(compact_windows.passages(docs.repartition(parts)).orderBy("doc_id").collect())
    finally:
        spark.conf.set(setting, before)
    assert sum(r.n_repeat_words > 0 for r in results[0]) > 50
    assert results[0] == results[1] == results[2]


def test_long_passages_come_whole(spark):
    """One passage of 1,500 words, a word changed in every 40: long beyond the outermost run that only the two share."""
    words = prose(5, 1500).split()
    changed = [f"new{k}" if k % 40 == 20 else w for k, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (0, " ".join(words[300:380]) + " " + prose(6, 60)), (3, " ".join(words[:100]) + " " + prose(8, 20))]
    got = {r.doc_id: r for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[2].n_repeat_words >= 1440 and got[3].n_repeat_words == 100 and {r.class_id for r in got.values()} == {0}


def test_clean_judges_each_row_by_its_text(spark, items, monkeypatch):
    """A contaminated row without an id goes, a clean row that shares an id with a contaminated one stays, for any size of the benchmark."""
    bad, good = prose(1, 30), prose(77, 30)
    docs = spark.createDataFrame([(None, bad, "x"), (7, bad, "x"), (7, good, "y"), (None, good, "z"), (8, None, ""), (7, good, "y")], "doc_id bigint, text string, row string")
    want = sorted([(None, good, "z"), (7, good, "y"), (7, good, "y"), (8, None, "")], key=repr)
    assert sorted(map(tuple, positional_index.clean(docs, items).collect()), key=repr) == want
    monkeypatch.setattr(positional_index, "BROADCAST_BYTES", 0)
    found = positional_index.clean(docs, items)
    assert found.columns == docs.columns and sorted(map(tuple, found.collect()), key=repr) == want


def test_op10_by_hand(spark, sf_dir, docs):
    """Training and scoring again, coordinate by coordinate, in plain Python, over all rows."""
    from zlib import crc32

    def plain(text):
        tokens, counts = ftrl_quality.TOKENS.findall((text or "").encode()), Counter()
        one = [crc32(t) for t in tokens]
        for h in one:
            counts[h % ftrl_quality.SIZE or 2] += 1
        for a, b in zip(one, one[1:], strict=False):
            slot = ((a * 0x9E3779B97F4A7C15 + b) * 0xC2B2AE3D27D4EB4F % 2**64 >> 40) % ftrl_quality.SIZE
            counts[ftrl_quality.SAME if a == b else slot or 2] += 1
        values = {k: math.log(1 + n) for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in values.values()))
        return {0: 1.0} | {k: v / norm for k, v in values.items()}

    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    own = pd.read_parquet(f"{sf_dir}/labels.parquet").dropna(subset=["quality"]).groupby("doc_id").quality.max()
    sample = sorted((i for i in own.index if crc32(str(i).encode()) % 5 and i in texts), key=lambda i: crc32(str(i).encode()))
    z, n, w = {}, {}, {}
    for _ in range(ftrl_quality.EPOCHS):
        for i in sample:
            x = plain(texts[i])
            p = 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - own[i]) * v
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) * w.get(k, 0.0)
                n[k] = n.get(k, 0.0) + g * g
                w[k] = 0.0 if abs(z[k]) <= 0.01 else (math.copysign(0.01, z[k]) - z[k]) / (1 + math.sqrt(n[k]) + 0.02)
    got = registry.op10_ftrl_quality(spark, sf_dir).toPandas().set_index("doc_id")
    want = {i: 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in plain(t).items()))) for i, t in texts.items()}
    assert set(got.index) == set(want) and max(abs(got.score[i] - s) for i, s in want.items()) < 1e-3
    assert all(got.held_out[i] == (crc32(str(i).encode()) % 5 == 0) and got.predicted[i] == (got.score[i] >= 0.3) for i in want)


def test_op3_by_hand(spark, sf_dir, docs):
    """Scores and marked words of every text again, by sums over the chain's states one token at a time."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = crf_toxicity.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = crf_toxicity.score(table, model).toPandas().set_index("doc_id")
    start, t01, t10, t11 = model.transitions
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))

    def chain(unary):
        """Marginals by forward and backward sums over both states."""
        ahead = [(0.0, unary[0] + start)]
        for u in unary[1:]:
            a, b = ahead[-1]
            ahead.append((add(a, b + t10), u + add(a + t01, b + t11)))
        back = [(0.0, 0.0)]
        for u in unary[:0:-1]:
            a, b = back[-1]
            back.append((add(a, t01 + u + b), add(t10 + a, t11 + u + b)))
        return [1 / (1 + math.exp(min(700.0, (a + x) - (b + y)))) for (a, b), (x, y) in zip(ahead, back[::-1], strict=True)]

    for i, text in zip(docs.doc_id, docs.text, strict=True):
        words, marks, part = crf_toxicity.TOKENS.findall((text or "").encode()), [], []
        for word in [*words, None]:
            if word is not None and word not in crf_toxicity.ENDS:
                part.append(float(model.weights[crf_toxicity.slots(word)].sum()) + model.constant)
                continue
            marks += chain(part) if part else []
            part = []
            if word is not None:
                marks.append(0.0)
        if marks:
            most, total = min(max(*marks, 6e-6, 6e-6), 1 - 6e-6), sum(marks) + 6e-6
            told = math.log(most / (1 - most)), math.log(total), math.log(total / len(marks))
        else:
            told = crf_toxicity.NOTHING
        want = 1 / (1 + math.exp(-min(40.0, max(-40.0, sum(a * b for a, b in zip(model.top, (1.0, *told), strict=True))))))
        assert abs(got.score[i] - want) < 1e-6 and (len(got.spans[i]) > 0) == any(m >= 0.5 for m in marks), i


def brute_rank(docs, items, k=50):
    """op11 by its definition, over (doc_id, text) and (item_id, text) rows."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(i, Counter(term.findall(lower(t)))) for i, t in docs]
    n_docs, words = sum(bool(c) for _, c in rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    wanted: dict = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(term.findall(lower(t)))
    out = []
    for item, terms in wanted.items():
        scores = []
        for at, (i, c) in enumerate(rows):
            m = 50 + (50 * sum(c.values()) * n_docs) // words if words else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i, at))
        out += [(item, r + 1, i, -s) for r, (s, _, i, _) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_op11(spark, sf_dir, duck, odd, items, none, monkeypatch):
    want = duck.execute(registry.ORACLE["op11_tput_search"]).df()
    pairs = pd.read_parquet(f"{sf_dir}/documents.parquet")[["doc_id", "text"]].itertuples(index=False, name=None)
    asked = pd.read_parquet(f"{sf_dir}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None)
    assert Counter(want[["item_id", "rank", "doc_id", "score"]].itertuples(index=False, name=None)) == brute_rank(pairs, asked)
    got = registry.op11_tput_search(spark, sf_dir)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    names = ["item_id", "rank"]
    assert got.toPandas().sort_values(names).reset_index(drop=True).equals(want[got.columns].sort_values(names).reset_index(drop=True).astype({"rank": "int32"}))
    # odd rows and few places; then lookups by a join, small segments and blocks, many rounds, and an index of all terms
    rows, questions = [(r.doc_id, r.text) for r in odd.collect()], [(r.item_id, r.text) for r in items.collect()]
    questions += [(7, "b a same"), (8, prose(2, 400)), (9, "Ünknown")]
    more = spark.createDataFrame(questions, "item_id bigint, text string")
    for k in (3, 50):
        assert Counter(map(tuple, tput_search.rank(odd, more, k=k).collect())) == brute_rank(rows, questions, k)
    assert tput_search.rank(none, more).count() == 0 and tput_search.rank(odd, more.limit(0)).count() == 0
    for name, value in (("LOOKUPS", -1), ("SEGMENT_BYTES", 300), ("CELLS", 40), ("ITEM_PAIRS", 30), ("ITEMS", 2)):
        monkeypatch.setattr(tput_search, name, value)
    assert Counter(map(tuple, tput_search.rank(odd.repartition(3), more, k=3).collect())) == brute_rank(rows, questions, 3)
    path = f"{common.checkpoint_dir(spark)}/index-of-a-test"
    tput_search.write_index(odd.repartition(2), path)
    for _ in range(2):
        assert Counter(map(tuple, tput_search.search(spark, path, more, k=4).collect())) == brute_rank(rows, questions, 4)


def byte_library():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op12(spark, sf_dir, docs, odd, none):
    library = byte_library()

    def want(i, text):
        ids = library.encode_ordinary(text or "")
        return i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = registry.op12_merge_replay(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want(i, t) for i, t in zip(docs.doc_id, docs.text, strict=True))
    assert Counter(map(tuple, merge_replay.encode(odd, RANKS).collect())) == Counter(want(r.doc_id, r.text) for r in odd.collect())
    assert merge_replay.encode(none, RANKS).count() == 0
    real = merge_replay.encode(spark.createDataFrame([(1, "It's two  words\n")], "doc_id bigint, text string"), RANKS, with_ids=True).first()
    assert list(real.ids) == library.encode_ordinary("It's two  words\n") and bytes(real.decoded) == b"It's two  words\n"


def test_op13(spark, sf_dir):
    vectors = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    check_whitening(registry.op13_svd_whitening(spark, sf_dir).toPandas(), list(zip(vectors.vec_id, vectors.embedding, strict=True)))


def check_whitening(got, rows, k=8):
    """op13's rows against exact deviations and numpy's eigenvectors."""
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows], np.int64)
    n, total = len(x), x.sum(axis=0)
    off = (n * x - total) / n
    value, vector = np.linalg.eigh(off.T @ off / n)
    value, vector = value[::-1][:k], vector[:, ::-1][:, :k]
    value, vector = value[value > 1e-9 * value[0]], vector[:, value > 1e-9 * value[0]]
    k = len(value)
    assert len(got) == n * k and (got.n == n).all() and sorted(got.component.unique()) == list(range(1, k + 1))
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, total, strict=True)) for row in x]
    assert Counter(got[got.component == 1][["vec_id", "deviation"]].itertuples(index=False, name=None)) == Counter(zip([i for i, _ in rows], exact, strict=True))
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, value / (sum(exact) / n**3), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    white = off @ vector / np.sqrt(value)
    for c in range(k):
        own = got[got.component == c + 1].sort_values(["vec_id", "whitened"]).whitened.to_numpy()
        ways = [np.array([w for _, w in sorted((i, s * float(w)) for (i, _), w in zip(rows, white[:, c], strict=True))]) for s in (1, -1)]
        assert min(np.abs(own - w).max() for w in ways) < 1e-7


def test_whitening_of_odd_tables(spark):
    nan, inf, rng = float("nan"), float("inf"), random.Random(3)
    good = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(40)]
    good += [(i, [0.5, -0.25, 1e-3, 3.0, 0.0]) for i in (90, 90, 91)]  # repeated
    bad = [(50, None), (51, [0.1, None, 0.2, 0.3, 0.4]), (52, [nan, 0.0, 0.0, 0.0, 0.0]), (53, [inf, 0.0, 0.0, 0.0, 0.0]), (54, []), (55, [1.0, 2.0]), (56, [1e300, 0.0, 0.0, 0.0, 0.0])]
    schema = "vec_id bigint, embedding array<double>, x int, c string, white int, n string"
    frame = lambda rows: spark.createDataFrame([(i, v, 1, "", 2, "") for i, v in rows], schema)
    check_whitening(whitening.whiten(frame(good + bad)).toPandas(), good)
    # fewer components than asked for, and dimensions that depend on each other
    low = [(i, [a, b, a + b, 2 * a]) for i in range(30) for a, b in [(rng.randrange(50) / 16, rng.randrange(50) / 16)]]
    got = whitening.whiten(frame(low)).toPandas()
    assert sorted(got.component.unique()) == [1, 2]
    check_whitening(got, low)
    # nothing varies, or nothing is there
    for rows in ([(1, [0.5, 0.5])] * 4, [(1, [0.5])], bad[:4], []):
        assert whitening.whiten(frame(rows)).count() == 0
    # deviations beyond 64 bits; beside such a component another can't be told from rounding
    far = [(i, [float(rng.randrange(-(10**9), 10**9)), float(i)]) for i in range(12)]
    got = whitening.whiten(frame(far)).toPandas()
    assert got.deviation.isna().all() and got.identity_error[0] < 1e-6 and sorted(got.vec_id) == list(range(12)) and got.explained[0] > 0.999
    ids = spark.createDataFrame([(None, [0.0, 1.0]), (None, [1.0, 0.5]), (3, [0.25, 0.75])], "vec_id bigint, embedding array<float>")
    assert whitening.whiten(ids).filter("vec_id is null").count() == 4


# structure


def test_small_blocks_find_the_same_links(spark):
    rng = np.random.default_rng(8)
    words = np.concatenate([np.uint64(rng.integers(0, 1 << 63)) ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)) for _ in range(3)])
    words = np.unique(words).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(enumerate(words)), "node bigint, fp bigint")
    want = groups([(i, j) for i in range(len(words)) for j in range(i) if ((words[i] ^ words[j]) & (1 << 64) - 1).bit_count() <= 2], range(len(words)))
    for block in (2, 10, 4096):
        found = groups([(r.a, r.b) for r in simhash.near_edges(nodes, block=block).collect()], range(len(words)))
        assert found == want


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_LEAST", 10)
    rng = random.Random(6)
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1040)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)] + [(5000, 5000), (1000, 1001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == groups(edges, {x for e in edges for x in e})


def test_passages_shared_by_many(spark):
    passage = prose(77, 70)
    rows = [(i, f"{prose(1000 + i, 80)} {passage} {prose(2000 + i, 40)}") for i in range(60)] + [(i, prose(3000 + i, 200)) for i in range(60, 90)]
    rows += [(90, " ".join("x" if k == 35 else w for k, w in enumerate(passage.split())))]
    got = {r.doc_id: r for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    assert got[0].n_repeat_words == 0 and all(got[i].n_repeat_words == 70 and got[i].class_id == 0 for i in [*range(1, 60), 90])
    assert all(got[i].n_repeat_words == 0 and got[i].class_id == i for i in range(60, 90))


def test_pipeline_equals_its_definition(spark, sf_dir, docs):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, sf_dir).toPandas().set_index("doc_id")
    rules = registry.op5_ngram_ratio(spark, sf_dir).toPandas().set_index("doc_id")
    left = [i for i in docs.doc_id if rules.kept[i]]
    fp = {i: simhash.fingerprint(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True) if rules.kept[i]}
    component = groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], left)
    left = [i for i in left if component[i] == i]
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    table = spark.createDataFrame([(i, texts[i]) for i in left], "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in compact_windows.passages(table).collect()}
    windows = windows_of(pd.read_parquet(f"{sf_dir}/benchmark.parquet")[["item_id", "text"]].itertuples(index=False, name=None))
    want = {}
    for i in left:
        gone = {j for s in spans[i] for j in range(s.a, s.b)}
        words = [w for j, w in enumerate(WORD.findall(texts[i])) if j not in gone]
        if words and not brute_hits(" ".join(words), windows)[-1]:
            want[i] = " ".join(words)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    assert set(got.index) == set(want) and len(want) < len(docs)
    assert all(list(got.ids[i]) == library.encode(want[i], add_special_tokens=False).ids for i in want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_licence_sql_on_odd_rows(odd):
    con = duckdb.connect()
    documents = pd.DataFrame([(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (None, 5)] + [(50, "A. Licensed under CC BY-NC 4.0. Distributed under my licence!")], columns=["doc_id", "text"])
    con.register("documents", documents)
    got = {r[0]: r for r in con.execute(license_rules.oracle_sql()).fetchall()}
    for i, t in zip(documents.doc_id, documents.text, strict=True):
        ids = license_rules.identify(t or "")
        assert got[i] == (i, len(ids), ",".join(ids), ",".join(license_rules.licences(ids)))


def test_licence_cases_in_sql_and_spark(spark):
    """Expectations written by hand, for both."""
    from test_pure import LICENCE_CASES

    con = duckdb.connect()
    documents = pd.DataFrame([(i, t) for i, (t, _) in enumerate(LICENCE_CASES)], columns=["doc_id", "text"])
    con.register("documents", documents)
    got = license_rules.scan(spark.createDataFrame(documents)).collect()
    assert {r.doc_id: r.licences for r in got} == {i: ",".join(want) for i, (_, want) in enumerate(LICENCE_CASES)}
    assert sorted(map(tuple, got)) == sorted(con.execute(license_rules.oracle_sql()).fetchall())


def test_wrapped_licence_sentences(spark):
    texts = ["Released into the public\ndomain.", "It is dedicated to the public \t domain", "placed in the public-domain!", "Distributed on an AS\nIS BASIS.", 'distributed on an "AS-IS" basis', "THIS\n  SOFTWARE IS PROVIDED BY THE AUTHORS AS\nIS", "The above copyright\nnotice and this permission notice shall be included", "the public. Domain"]
    want = {i: license_rules.identify(t) for i, t in enumerate(texts)}
    assert all(want[i] for i in range(7)) and not want[7]
    con = duckdb.connect()
    documents = pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"])
    con.register("documents", documents)
    got = license_rules.scan(spark.createDataFrame(documents)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(license_rules.oracle_sql()).fetchall())
    assert {r.doc_id: r.sentence_ids for r in got} == {i: ",".join(ids) for i, ids in want.items()}


def brute_near(text, windows, slop=3):
    at, items = {}, set()
    for k, w in enumerate(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))):
        at.setdefault(w, []).append(k)
    for window, own in windows.items():
        if len(window) > 1 and all(w in at for w in window):
            starts = set(range(min(at[window[0]]) - slop, max(at[window[0]]) + slop + 1))
            for k, w in enumerate(window):
                starts &= {p - k + d for p in at[w] for d in range(-slop, slop + 1)}
            items |= own if starts else set()
    return len(items)


def test_op9_reports_nearby_matches(spark, sf_dir, docs, tmp_path):
    benchmark = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    windows = windows_of(zip(benchmark.item_id, benchmark.text, strict=True))
    got = registry.op9_positional_index(spark, sf_dir).toPandas().set_index("doc_id")
    assert all(got.n_near_items[i] == brute_near(t, windows) for i, t in zip(docs.doc_id, docs.text, strict=True))
    # one word put in, or two swapped, inside each window
    words = prose(500, 60).split()
    put_in = " ".join(w if k % 8 else f"{w} extra" for k, w in enumerate(words))
    swapped = " ".join(words[k + 1 if k % 8 == 0 else k - 1 if k % 8 == 1 else k] for k in range(len(words)))
    spark.createDataFrame([(1, put_in), (2, swapped), (3, " ".join(words)), (4, prose(501, 60))], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: r for r in registry.op9_positional_index(spark, str(tmp_path)).collect()}
    assert {i: (r.n_items, r.n_near_items) for i, r in rows.items()} == {1: (0, 1), 2: (0, 1), 3: (1, 1), 4: (0, 0)}


def test_first_document_with_a_part_of_the_passage(spark):
    rows, want, i = [], {}, 0
    for case in range(40):
        p = prose(7000 + case, 70).split()
        parts = [[p[:45], p[:55], p[:55]], [p[7:52], p[:60], p[:60]], [p[:46], p[25:70], p, p], [p[:50], p, p], [p[:45] + prose(i + 80000, 30).split() + p[:60], p[:60]]][case % 5]
        for k, part in enumerate(parts):
            rows.append((i, " ".join([prose(9000 + 2 * i, 30), *part, prose(9001 + 2 * i, 30)])))
            want[i] = 0 if k == 0 or case % 5 < 3 and k < len(parts) - 1 else len(part)
            i += 1
        if case % 5 == 3:
            want[i - 2] = 50
    got = {r.doc_id: r.n_repeat_words for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    assert got == want


def test_recall_of_short_similar_passages(spark):
    rows, pairs = [], {}
    for k in range(160):
        n, kind, i = 50 + k % 16, k // 16 % 4, 2 * k
        p = prose(20000 + k, n).split()
        at = n // 2 - k % 2
        changed = [p[:at] + ["changed"] + p[at + 1 :], p[:at] + ["more"] + p[at:], p[: at - 1] + ["changed"] + p[at:], p[: n - 3] + ["changed"] + p[n - 2 :]][kind]
        rows += [(i + d, " ".join([prose(30000 + 2 * (i + d), 40), *x, prose(30001 + 2 * (i + d), 40)])) for d, x in ((0, p), (1, changed))]
        pairs[i + 1] = len(changed) - 3 * (kind == 3)
    got = {r.doc_id: r.n_repeat_words for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    missed = [i for i, n in pairs.items() if got[i] < min(n, 50)]
    assert not [i for i in missed if pairs[i] >= 50]
    assert all(got[i] == 0 for i in range(0, 320, 2))


@pytest.mark.parametrize(("n", "changes"), [(50, 1), (60, 1), (80, 1), (100, 2), (150, 3)])
def test_recall_of_similar_passages(spark, n, changes):
    """Words changed, left out or put in anywhere; what is similar enough is found, among many others."""
    rng, rows, similar = random.Random(n), [], set()
    for k in range(150):
        p = prose(40000 + 1000 * n + k, n).split()
        other = list(p)
        for at in sorted(rng.sample(range(n - 1), changes), reverse=True):
            kind = rng.randrange(3)
            other[at : at + (kind != 1)] = [] if kind == 2 else [f"new{at}"]
        x, y = (set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (p, other))
        if len(x & y) >= 0.8 * len(x | y) and len(other) >= 50:
            similar.add(2 * k + 1)
        rows += [(2 * k + d, " ".join([prose(50000 + 2 * k + d, 40), *w, prose(60000 + 2 * k + d, 40)])) for d, w in ((0, p), (1, other))]
    got = {r.doc_id: r.n_repeat_words for r in compact_windows.passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    assert len(similar) >= 50 and sum(got[i] >= 0.9 * n for i in similar) >= 0.95 * len(similar)
    assert not any(got[i] for i in got if i % 2 == 0)


def test_copies_are_linked_once_and_negative_ids_count(spark):
    text, part = prose(1, 90), prose(2, 70)
    rows = [(-3, text), (1, text), (2, text), (5, f"{prose(3, 30)} {part}"), (6, f"{part} {prose(4, 30)}"), (7, f"{part} {prose(4, 30)}"), (8, prose(5, 49)), (9, prose(5, 49)), (None, text)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in compact_windows.passages(table).collect()}
    assert [got[i].n_repeat_words for i in (-3, 1, 2, 5, 6, 7, 8, 9)] == [0, 90, 90, 0, 70, 100, 0, 0]
    assert [got[i].class_id for i in (-3, 1, 2, 5, 6, 7, 8, 9)] == [-3, -3, -3, 5, 5, 5, 8, 9]
    assert sorted(r.doc_id for r in compact_windows.without_repeats(table).collect() if r.doc_id is not None) == [-3, 5, 6, 8, 9]


def test_large_groups_come_in_parts(spark, monkeypatch):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"key": [1, 1, 2, 3, 3]}), pa.RecordBatch.from_pydict({"key": [3, 3, 3]}), pa.RecordBatch.from_pydict({"key": [3, 4]})]
    whole = [(t.column("key").to_pylist(), b.tolist()) for t, b in compact_windows.groups(iter(batches), 1)]
    assert [k for k, _ in whole] == [[1, 1, 2], [3] * 6, [4]] and sum(b[0] for _, b in whole) == 3


@pytest.mark.parametrize("kind", ["odd", "none"])
def test_pipeline_on_odd_and_empty_tables(spark, odd, none, marks, items, kind, tmp_path):
    """Every stage, in a row, over written tables: nulls, empty and long texts, ties, repeated rows, no rows."""
    import corpus_pipeline

    docs = odd if kind == "odd" else none
    for name, table in (("documents", docs), ("labels", marks if kind == "odd" else marks.limit(0)), ("benchmark", items if kind == "odd" else items.limit(0))):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in corpus_pipeline.STAGES:  # each by itself
        got = stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert got.count() <= docs.count() and (stage is corpus_pipeline.encoding_stage or got.columns == docs.columns)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if kind == "none":
        assert rows == []
    else:  # 5 and 6 leak, 1 to 4, 8 and 9 have few or repeated words
        assert {r.doc_id for r in rows} <= {7, None} and all(r.n_tokens == len(r.ids) > 0 for r in rows)


def test_a_session_without_checkpoint_folder(spark, monkeypatch):
    from countloom.llm import common

    class Conf:
        def get(self, name, default=None):
            return {"spark.sql.warehouse.dir": "hdfs://shared/warehouse"}.get(name, default)

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert common.checkpoint_dir(Session("spark://host:7077")) == "hdfs://shared/warehouse/countloom-checkpoints"
    assert common.checkpoint_dir(Session("local-cluster[2,1,900]")).startswith("hdfs://")
    assert Path(common.checkpoint_dir(Session("local[4]"))).exists()
