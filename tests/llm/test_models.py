"""Classifiers by held-out accuracy, the language model against a plain Katz model, decontamination against all windows, chat templates by round trip."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timeloom.llm import chat, decontam, langid, lm, toxicity

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(100_000, None), (100_001, ""), (100_002, "123 !!! \n"), (100_003, "x" * 150_000), (100_004, "the the"), (100_004, "the the"), (None, "no id at all")]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def with_odd(spark, docs):
    extra = spark.createDataFrame([(i, t, None, "s", 0) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.unionByName(extra)


def test_language_held_out(spark, docs):
    got = {r.doc_id: r for r in langid.predict_languages(with_odd(spark, docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (100_000, 100_001, 100_002)] == ["und"] * 3 and got[100_000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    assert langid.predict_languages(docs.where("false")).count() == 0
    assert {(r.lang_pred, r.score) for r in langid.predict_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {("und", 0.0)}


def test_language_of_repeated_rows_and_clashing_columns(spark, docs):
    few = with_odd(spark, docs).where("doc_id is null or doc_id < 40 or doc_id >= 100000")
    filters = langid.learn_filters(docs)
    names = few.unionByName(few).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x")).withColumn("held_out", F.lit("y")).withColumn("gram", F.lit(2)).withColumn("n", F.lit(3))
    key = lambda r: (r.doc_id is None, r.doc_id, r.lang_pred, r.score, r.held_out)
    once, twice = (sorted(map(key, langid.predict_languages(x, filters).collect()), key=str) for x in (few, names))
    assert twice == sorted(once * 2, key=str) and len(once) == few.count()
    assert langid.learn_filters(names).languages == langid.learn_filters(few).languages


def test_filters_have_all_their_ngrams_and_few_others():
    rng = np.random.default_rng(0)
    g = {n: np.unique(rng.integers(0, 1 << 32, 2000).astype(np.uint32)) for n in ("a", "b", "c")}
    f = langid.Filters.build(g)
    for k, n in enumerate(f.languages):
        assert f.hits(g[n], np.array([len(g[n])]))[k, 0] == len(g[n])
    other = rng.integers(0, 1 << 32, 50_000).astype(np.uint32)
    share = f.hits(other, np.array([len(other)]))[:, 0] / len(other)
    assert np.abs(share - f.false_rates()).max() < 0.01
    many = langid.Filters.build({f"l{i:03}": np.array([i], np.uint32) for i in range(130)})
    assert many.hits(np.array([77], np.uint32), np.array([1]))[77, 0] == 1


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(with_odd(spark, docs), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = {i for i in truth if got[i].held_out}
    said = [i for i in held if got[i].predicted]
    assert sum(truth[i] for i in held) > 5 and sum(truth[i] for i in said) / len(said) > 0.9 and sum(truth[i] for i in said) / sum(truth[i] for i in held) > 0.5
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == 1000 + len({i for i, _ in ODD})
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {i for i, r in got.items() if not r.predicted and i is not None and i < 100_000}
    assert not any(r.predicted for r in toxicity.score_toxicity(docs, labels.where("false")).collect())
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == toxicity.drop_toxic(docs.where("false"), labels).count() == 0
    names = docs.withColumn("positive", F.lit("x")).withColumn("score", F.lit("y")).withColumn("toxic", F.lit(1)).withColumn("held_out", F.lit(None).cast("string"))
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(names, labels).collect()}.keys() == truth.keys() | {r.doc_id for r in docs.collect()}
    assert toxicity.drop_toxic(names, labels).columns == names.columns


def test_nnpu_risk_separates_a_known_mixture():
    rng = np.random.default_rng(3)
    n = 4000
    toxic = np.concatenate([np.ones(400, bool), rng.random(n - 400) < 0.1])
    positive = np.arange(n) < 400
    x = rng.random((n, 2)) < np.where(toxic[:, None], [0.9, 0.3], [0.02, 0.3])
    r, c = np.nonzero(x)
    w, b = toxicity.nnpu_fit(r, c, np.ones(len(r)), positive, 2, 0.1)
    said = x @ w + b > 0
    assert (said[400:] == toxic[400:]).mean() > 0.95


class PlainKatz:
    """Katz backoff from dictionaries."""

    def __init__(self, texts, order):
        self.order, self.c = order, [collections.Counter() for _ in range(order)]
        for words in texts:
            padded = ["<s>"] * (order - 1) + words
            for i in range(len(words)):
                for m in range(order):
                    self.c[m][tuple(padded[i + order - 1 - m : i + order])] += 1
        self.n, self.v = sum(self.c[0].values()), len(self.c[0])
        self.p = functools.cache(self.p)
        self.of, self.d = [collections.defaultdict(list) for _ in range(order)], [None]
        for m in range(1, order):
            for gram, k in self.c[m].items():
                self.of[m][gram[:-1]].append((gram[-1], k))
            seen = collections.Counter(self.c[m].values())
            self.d.append(lm.good_turing([seen[r] for r in range(1, lm.LAST + 2)]))

    def base(self, w):
        return (self.c[0][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def p(self, h, w):
        m = len(h)
        if not m:
            return self.base(w)
        if h not in self.of[m]:
            return self.p(h[1:], w)
        cut = lambda k: self.d[m][min(k, lm.LAST + 1)] * k
        total = sum(k for _, k in self.of[m][h])
        mass = sum(cut(k) for _, k in self.of[m][h]) / total
        scale = min(1, (1 - 0.5 / (total + 1)) / mass)
        if (*h, w) in self.c[m]:
            return scale * cut(self.c[m][(*h, w)]) / total
        return (1 - scale * mass) / (1 - sum(self.p(h[1:], x) for x, _ in self.of[m][h])) * self.p(h[1:], w)

    def score(self, words):
        padded = ["<s>"] * (self.order - 1) + words
        return sum(math.log10(self.p(tuple(padded[i : i + self.order - 1]), w)) for i, w in enumerate(words))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_scores(spark, order, tmp_path):
    rows = [(i, t) for i, t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows, new = rows[:25] + [(900, None), (901, ""), (902, "never seen words"), (903, "the of the of"), (903, "the of the of"), (None, "x y")], rows[50:60] + [(904, "quite new words the of the")]
    frame = lambda x: spark.createDataFrame([(i, t, 1, "b") for i, t in x], "doc_id long, text string, score int, block string")
    tokens = lambda t: [*WORD.findall(lower(t or "")), "</s>"]
    model = PlainKatz([tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10], order)

    def want(part):
        out = collections.defaultdict(list)
        for i, t in part:
            w = tokens(t)
            out[i, len(w), sum(model.c[0][(x,)] > 0 for x in w), model.n].append((sum(math.log10(model.base(x)) for x in w), model.score(w)))
        return out

    def same(got, part):
        left = want(part)
        assert len(got) == len(part)
        for r in got:
            scores = left[r.doc_id, r.n_tokens, r.n_known, r.train_tokens]
            assert any(abs(r.base_score - a) < 1e-6 and abs(r.score - b) < 1e-5 * max(1, abs(b)) for a, b in scores)

    folder = f"{tmp_path}/model"
    same(lm.score_documents(frame(rows), order=order, path=folder, block_bytes=40_000, bucket_entries=6000).collect(), rows)
    same(lm.score_with(frame(new), folder, block_bytes=30_000).collect(), new)
    same(lm.score_with(frame(rows), folder).collect(), rows)
    if order > 1:
        h = max(model.of[order - 1], key=lambda k: len(model.of[order - 1][k]))
        assert abs(sum(model.p(h, w) for (w,) in model.c[0]) + model.p(h, "\0") - 1) < 1e-9
    assert lm.score_documents(frame(rows).where("doc_id < 0"), order=order).count() == 0


def edit(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(last[j + 1] + 1, new[-1] + 1, last[j] + (x != y)))
        last = new
    return last[-1]


def random_words(rng, n, vocab):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


def edited(rng, item, edits, vocab):
    x = list(item)
    swaps = rng.randint(0, edits // 2)
    for _ in range(edits - 2 * swaps):
        x[rng.randrange(len(x))] = f"w{rng.randrange(vocab)}"
    for _ in range(swaps):
        del x[rng.randrange(len(x))]
        x.insert(rng.randint(0, len(x)), f"w{rng.randrange(vocab)}")
    return x


def nearest_windows(words, item, most):
    """(distance, first word) of the best of ALL windows; none over the limit."""
    found = min(((edit(words[s : s + len(item)], item), s) for s in range(max(1, len(words)))), default=(99, 0)) if words else (99, 0)
    return found if item and found[0] <= most else None


def test_leaks_equal_the_check_of_all_windows(spark):
    import random

    rng = random.Random(4)
    items = [random_words(rng, rng.choice([1, 2, 4, 12, 30, 50]), 500) for _ in range(25)]
    docs = []
    for i in range(80):
        body = random_words(rng, rng.randint(0, 60), 500)
        if i % 2:
            x = rng.choice(items)
            body[len(body) // 2 : len(body) // 2] = edited(rng, x, rng.randint(0, len(x) // 4), 500)
        docs.append((i, " ".join(body).replace("w1", "W1") + "."))
    docs += [(200, None), (201, ""), (202, "..."), (203, " ".join(items[0])), (203, " ".join(items[0])), (204, " ".join(random_words(rng, 30_000, 100_000) + items[4]))]
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)] + [(90, None), (91, "!!!")], "item_id long, text string")
    df = spark.createDataFrame([(i, t, 5, None) for i, t in docs], "doc_id long, text string, item_id int, leak string")
    words = lambda t: re.findall(r"[a-z0-9]+", lower(t or ""))
    want = collections.Counter()
    for i, t in docs:
        for k, x in enumerate(items):
            best = nearest_windows(words(t), x, int(decontam.RATE * len(x))) if i != 204 else (0, 30_000) if k == 4 else None
            if best:
                want[i, k, best[1], best[0]] += 1
    got = collections.Counter((r.doc_id, r.item_id, r.first_word, r.distance) for r in decontam.find_leaks(df, bench).collect() if r.doc_id != 204 or r.item_id == 4)
    assert sum((want & got).values()) >= 0.98 * sum(want.values()) and {g[:2] for g in got} <= {w[:2] for w in want}
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r.doc_id for r in decontam.find_leaks(df, bench).collect()}
    several = decontam.find_leaks(df, bench, part_words=120)
    assert decontam.part_count(bench, 120) > 3 and sorted(map(tuple, several.collect())) == sorted(map(tuple, decontam.find_leaks(df, bench).collect()))
    left = decontam.drop_leaks(df, bench, part_words=120)
    assert left.columns == df.columns and sorted(map(str, left.collect())) == sorted(map(str, kept.collect())) and decontam.drop_leaks(df.where("false"), bench, part_words=120).count() == 0
    assert decontam.find_leaks(df.where("false"), bench).count() == 0 and decontam.find_leaks(df, bench.where("false")).count() == 0
    assert decontam.drop_leaks(df.where("false"), bench).count() == 0 and decontam.drop_leaks(df, bench.where("false")).count() == len(docs)


def index_of(items):
    h, at = decontam.word_ids(pa.array([" ".join(x) for x in items]))
    return decontam.Index(np.arange(len(items)), [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])


def test_window_whose_shared_runs_all_stand_off_its_place():
    item = [f"a{i}" for i in range(1, 13)]
    text = "x0 x1 a1 a2 q a3 a4 a5 a6 a7 a8 a9 a11 a12 y0 y1"
    index = index_of([item])
    assert edit(text.split()[2:14], item) == 2 == index.most[0]
    assert index.search(pa.array([text])) == [[{"item_id": 0, "first_word": 2, "n_words": 12, "distance": 2}]]


@pytest.mark.parametrize("size", [10, 15, 60, 150, 300])
def test_recall_at_the_largest_distance(size):
    """Leaks edited as far as the limit lets, in texts of their own; found against all windows."""
    import random

    rng, most = random.Random(size), int(decontam.RATE * size)
    items = [random_words(rng, size, 5000) for _ in range(20)]
    texts, want = [], set()
    for i in range(120):
        x = edited(rng, items[i % 20], most, 5000)
        if edit(x, items[i % 20]) == most or size > 60:
            want.add((i, i % 20))
        texts.append(" ".join(random_words(rng, 5, 5000) + x + random_words(rng, 5, 5000)))
    found = index_of(items).search(pa.array(texts))
    got = {(i, leak["item_id"]) for i, x in enumerate(found) for leak in x}
    assert got <= {(i, i % 20) for i in range(120)} and len(want & got) >= 0.97 * len(want) and len(want) > 50


def test_a_run_that_very_many_items_share_costs_little():
    import random
    import time

    rng = random.Random(2)
    items = [["what", "is", "the", *random_words(rng, rng.randint(12, 40), 20_000)] for _ in range(3200)]
    index = index_of(items)
    text = " ".join(w for _ in range(60) for w in ["what", "is", "the", *random_words(rng, 17, 20_000)])
    index.search(pa.array([text]))
    began = time.time()
    assert index.search(pa.array([text])) == [[]]
    assert time.time() - began < 1


def test_repetitions_have_no_upper_bound():
    assert [decontam.repetitions(n, 0.2) for n in (30, 150, 600)] == sorted(decontam.repetitions(n, 0.2) for n in (30, 150, 600)) and decontam.repetitions(600, 0.2) > 300


def test_verbatim_passages_are_found(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()}
    items = bench.collect()
    want = {(r.doc_id, i.item_id) for r in docs.select("doc_id", "text").collect() for i in items if i.text in r.text}
    assert want and want <= got


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "a<|b<\\\\|c\\", "", None, "é\n\nline", "<" * 5 + "|", "x" * 100_000]
    rows = [(k // 4, k, ("user", "assistant", "system\n\\n<|", None)[k % 4], t, 0) for k, t in enumerate(texts * 2)] + [(None, 1, "assistant", "nobody's", 0), (9, 1, "user", "b", 0), (9, 1, "user", "a", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, spans int")
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    groups = collections.defaultdict(list)
    for c, k, role, t, _ in rows:
        groups[c].append((k, role or "", t or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
    for r in made.collect():
        assert chat.read_turns(r.text) == [(role, t) for _, role, t in sorted(groups[r.conv_id])]
    assert chat.format_conversations(df.where("false")).count() == 0


def test_template_language():
    run = lambda s, **n: chat.compile_template(s)(n)[0]
    assert run("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[1, 2, 3]) == "1,2,3"
    assert run("{% set a = 'x' ~ 1 %}{{ a | upper }}{{ 'y' if b and 1 < 2 else 'n' }}", b=True) == "X1y"
    assert run("{% if a == 1 %}one{% elif a == 2 %}two{% else %}more{% endif %}", a=2) == "two"
    text, spans = chat.compile_template("a{% generation %}bc{{ x }}{% endgeneration %}d")({"x": "!"})
    assert text == "abc!d" and "".join(text[a:b] for a, b in spans) == "bc!"
    tree = chat.fold(chat.Parser("{{ 'a' + 'b' | upper }}{% if 1 == 2 %}no{% else %}c{% endif %}d").template())
    assert [(p.kind, p.value) for p in tree.parts] == [("text", "aBcd")]
    for bad in ("{% for x %}{% endfor %}", "{{ x. }}", "{{ f(1) }}", "{% if a %}", "{{ x | eval }}", "{{ 'a' 'b' }}", "{{ § }}"):
        with pytest.raises(chat.TemplateError):
            run(bad, x=1, f=print, a=1)
    assert run("a  {%- if true -%}  b  {%- endif %}  c{{- ' d' }} {# note }} #}e") == "ab  c d e"
    assert run("{{ '}}' }}{% if '%}' == x %}{{ \"{%\" }}{% endif %}", x="%}") == "}}{%"
    assert run("{% if y is defined %}y{% elif x is not none and 2 not in x %}{{ x[-1] }}{% endif %}{{ 7 % 4 - -1 }}{{ 2 * 3 }}", x=[1, 5]) == "546"
    assert run("{% if m.role is defined and m.name is not defined %}{{ m.role is string }}{% endif %}", m={"role": "user"}) == "true"
    for bad in ("{{ 1 + 'a' }}", "{% for x in 3 %}{% endfor %}", "{{ 'a' * 9 }}", "{{ '%s' % x }}", "{{ none | length }}", "{{ x < 'a' }}", "{{ 1 % 0 }}", "{{ x", "{% if x", "{{ x is odd }}", "{{ " + "(" * 5000 + "1" + ")" * 5000 + " }}", "{{ " + "not " * 5000 + "1 }}", "{% if x %}" * 3000):
        with pytest.raises(chat.TemplateError):
            run(bad, x=1)
    for deny in ("{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ y.append }}"):
        with pytest.raises(chat.TemplateError):
            run(deny, x="s", y=[1])


@pytest.mark.parametrize("size", [12, 20])
def test_recall_and_cost_with_common_words_and_very_many_items(size):
    """10,000 items of words by a Zipf law; leaks edited as far as the limit lets, found among windows that share buckets with nearly every item."""
    import random
    import time

    rng, numbers = random.Random(size), np.random.default_rng(size)
    share = 1 / np.arange(1, 20_001)
    draw = lambda n: [f"w{i}" for i in numbers.choice(20_000, n, p=share / share.sum())]
    items, most = [draw(size) for _ in range(10_000)], int(decontam.RATE * size)
    index, texts, want = index_of(items), [], set()
    for i in range(80):
        x = edited(rng, items[i], most, 20_000)
        if edit(x, items[i]) == most:
            want.add((i, i))
        texts.append(" ".join(draw(5) + x + draw(5)))
    found = index.search(pa.array(texts))
    got = {(i, leak["item_id"]) for i, x in enumerate(found) for leak in x}
    assert len(want) > 40 and len(want & got) >= 0.97 * len(want)
    clean = pa.array([" ".join(draw(500)) for _ in range(40)])
    index.search(clean)
    began = time.time()
    index.search(clean)
    assert time.time() - began < 2


def test_shared_words_by_hand():
    rng = np.random.default_rng(4)
    windows, items = rng.integers(0, 6, (50, 7)).astype(np.uint64) << np.uint64(8), rng.integers(0, 6, (50, 5)).astype(np.uint64) << np.uint64(8)
    assert decontam.shared_words(windows, items).tolist() == [sum(x in w for x in i) for w, i in zip(windows.tolist(), items.tolist(), strict=True)]
