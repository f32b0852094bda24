"""The training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.llm import chat, common, components, decontam, langid, lm_score, packing, quality, queries, similarity, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "one two three", "en", "s", 13),
    (4, "one two three", "en", "s", 13),
    (None, "no id here at all", "en", None, 9),
    (5, "word " * 30_000, "en", "s", 150_000),
    (6, "a" * 100_000, "de", "t", 100_000),
    (7, "é ß 漢字 \U0001f600  two  blanks ", "fr", "t", 10),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use inside."""
    extra = ["n", "df", "token", "key", "side", "kind", "prefix"]
    return spark.createDataFrame(ODD, DOC).withColumns({c: F.lit("x") for c in extra})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components_by_both_ways(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5001 + i) for i in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for x in list(up)}
    table = spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long").repartition(4)
    for task_edges in (1000, 30):
        assert {r["node"]: r["component"] for r in components.connected_components(table, task_edges).collect()} == want


def shingle_sets(rows, k):
    out = {}
    for doc_id, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_links(sets, percent):
    up, links = {i: i for i in sets}, Counter()
    having = defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sorted(sets.items()):
        shared = Counter(j for t in s for j in having[t])
        for t in s:
            having[t].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                links.update((i, j))
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i), links[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_similarity_equals_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_DOCS", 4)  # so that candidate sets are cut into blocks
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    near = []
    for i in range(40):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(99)}"
        near.append((10_000 + i, " ".join(words)))
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).select("doc_id", "text").collect()] + near
    found = similarity.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in found} == brute_links(shingle_sets(rows, k), percent)


def test_a_candidate_set_is_dealt_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_DOCS", 4)
    sent = {}
    for m in (400, 1600):
        members = spark.range(m).selectExpr("0L AS comp", "id % 2 + 100 AS n", "id AS s1", "id AS s2", "id AS doc_id", "1L AS copies")
        packed = common.materialize(similarity.blocks(similarity.placed(members, 90).withColumn("tokens", F.array(F.col("doc_id")))))
        left, right = similarity.deal(packed)
        sent[m] = sum(x.agg(F.sum(F.size("block"))).first()[0] for x in (left, right))
        met = left.alias("a").join(right.alias("b"), "key").filter("key.x < key.y OR key.step = 1 OR a.h < b.h").select("a.id", "b.id")
        met = [frozenset(r) for r in met.collect()]
        n = packed.count()
        assert len(met) == len(set(met)) == n * (n - 1) // 2  # each pair of blocks once
    assert sent[1600] <= 4 * sent[400] <= 4 * 4 * similarity.GRID * 400


def test_similarity_defines_odd_rows(spark, odd, none):
    found = [tuple(r) for r in similarity.similarity_components(odd).collect()]
    assert sorted(x for x in found if x[0] == 4) == [(4, 1, 4, 1)] * 2  # repeated rows: copies of one node
    assert {(1, 0, 1, 0), (2, 0, 2, 0), (3, 0, 3, 0), (None, 1, None, 0), (5, 1, 5, 0)} <= set(found) and len(found) == len(ODD)
    assert similarity.similarity_components(none).count() == 0


def test_a_shingle_of_all_documents_joins_none(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(25)) + " all of them say this"
    rows = [(i, text()) for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    own = common.materialize(similarity.sketch(frame, 5, 80).filter("n > 0"))
    edges = similarity.candidate_edges(similarity.prefixes(own, 80), 80)
    assert edges.distinct().count() == 20
    for limit in (64, 3):  # pairs, and pivots for nearly all lists
        monkeypatch.setattr(similarity, "LIST", limit)
        found = {r["doc_id"]: r["component_id"] for r in similarity.similarity_components(frame).collect()}
        assert all(found[i] == (i - 5000 if i >= 5000 else i) for i in found)


def test_warc_reads_in_tasks_by_bytes(spark):
    rows = [(i, f"u{i}", "".join(random.Random(i).choices("abcdefgh", k=20_000))) for i in range(40)]
    index = warc.write_archives(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)))
    read = warc.read_records(index, span_bytes=10_000, task_bytes=20_000)
    assert read.rdd.getNumPartitions() >= 10 and read.count() == 40 and read.filter("NOT intact").count() == 0
    empty = warc.write_archives(warc.plan_records(spark.createDataFrame([], "page_id long, url string, html string")))
    assert warc.read_records(empty).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "x\ny", ""), (5, "u", "b" * 200_000), (None, "u", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    index = warc.write_archives(warc.plan_records(pages.repartition(2)), roll_bytes=300)
    found = {r["record_id"]: r for r in warc.read_records(index).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in found.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2)}
    assert bytes(found[5]["payload"]) == b"b" * 200_000 and bytes(found[2]["payload"]).decode() == "<p>é</p>" and found[1]["payload_bytes"] == 9
    assert all(r["intact"] for r in found.values()) and found[3]["uri"] is None and found[4]["uri"] == "x%0Ay"
    assert warc.read_records(index.filter("record_id = 5")).count() == 1
    assert warc.read_records(index.limit(0)).count() == 0


def test_quality_equals_plain_loops(spark, odd, none):
    text = "a b c d e f g h " * 4 + "\nx ### y\nx ### y\n \n"
    rows = [*ODD, (9, text, "en", "u", 1)]
    found = {(r["doc_id"], r["n_words"]): r for r in quality.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    for doc_id, text, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        r = found[doc_id, len(w)]
        assert (r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    assert quality.quality_rules(none).count() == 0 and quality.quality_rules(odd).count() == len(ODD)


def test_bad_hosts_take_their_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, good if i % 50 == 0 else "short", None, "bad", 0) for i in range(400)] + [(1000 + i, good, None, f"h{i % 9}", 0) for i in range(200)]
    found = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(found[i] for i in range(400)) and all(found[1000 + i] for i in range(200))


def test_host_verdicts_equal_sql(spark):
    import duckdb

    good = " ".join(f"w{i}" for i in range(50))
    rows = [(i, good if i % 50 == 0 else "short", None, "bad", 0) for i in range(400)] + [(1000 + i, "short" if i % 10 == 0 else good, None, f"h{i % 9}", 0) for i in range(900)]
    rows += [(5000 + i, "short" if i < 3 else good, None, "few", 0) for i in range(6)] + [(6000, good, None, None, 0)]
    frame = spark.createDataFrame(rows, DOC)
    documents = frame.toPandas()  # noqa: F841
    want = duckdb.sql(queries.ORACLES["op3_host_quality"]).fetchall()
    found = quality.quality_rules(frame)
    assert sorted(want) == sorted(tuple(r) for r in found.drop("host_rate").collect())
    lost = {r["doc_id"] for r in found.filter("NOT kept AND NOT base_failed").collect()}
    assert lost == {i for i in range(0, 400, 50)}
    kept = quality.drop_low_quality(frame.unionByName(frame.filter("doc_id = 6000")).withColumn("doc_id", F.when(F.col("doc_id") < 5000, F.col("doc_id"))))
    assert kept.count() == found.filter("kept").count() + 1 and kept.columns == frame.columns


def test_loss_models(spark, odd, none):
    rows = [(i, "good plain words here", None, None, 0) for i in range(20)] + [(100 + i, "bad noisy stuff there", None, None, 0) for i in range(20)]
    target = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    found = {r["doc_id"]: r for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, DOC), target).collect()}
    assert found[15]["score"] < 0 < found[110]["score"] and found[3]["n_tokens"] == 4
    assert found[3]["score"] == pytest.approx(found[3]["target_loss"] - found[3]["background_loss"], abs=1e-9)
    edge = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm_score.cross_entropy_difference(odd, target).collect()}
    assert edge[1, 0] is None and edge[2, 0] is None and edge[5, 30_000] is not None
    assert lm_score.cross_entropy_difference(none, target).count() == 0


def test_loss_is_that_of_a_plain_loop(spark):
    rows = docs(spark).select("doc_id", "text").collect()
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in rows}
    counts = Counter(w for x in words.values() for w in x)
    vocab = {w: i + 1 for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: lm_score.SYMBOLS - 2])}
    pairs = [Counter(), Counter()]
    for d, x in words.items():
        ids = [lm_score.START, *(vocab.get(w, 0) for w in x)]
        for p in zip(ids, ids[1:], strict=False):
            pairs[0][p] += 1
            pairs[1][p] += d in good

    def loss(c, d):
        single = [lm_score.ADDED] * lm_score.SYMBOLS
        before = Counter()
        for (a, b), n in c.items():
            single[b] += n
            before[a] += n
        total = sum(single)
        ids = [lm_score.START, *(vocab.get(w, 0) for w in words[d])]
        import math

        own = [-math.log(lm_score.MIX * (c[a, b] / before[a] if before[a] else single[b] / total) + (1 - lm_score.MIX) * single[b] / total) for a, b in zip(ids, ids[1:], strict=False)]
        return sum(own) / len(own)

    found = {r["doc_id"]: r for r in queries.QUERIES["op4_cross_entropy_difference"](spark, SF).collect()}
    for d in list(words)[:5]:
        assert found[d]["background_loss"] == pytest.approx(loss(pairs[0], d), rel=1e-4) and found[d]["target_loss"] == pytest.approx(loss(pairs[1], d), rel=1e-4)


def test_losses_know_rare_words(spark):
    """Two documents of words far down the list, one like the target's: no word is merged with others."""
    common = [" ".join(f"common{j}" for j in range(1500)) for _ in range(4)]
    rows = [(i, t, None, None, 0) for i, t in enumerate(common)]
    rows += [(10, "ruby topaz opal garnet", None, None, 0), (11, "opal ruby garnet topaz", None, None, 0), (12, "rust tin zinc lead", None, None, 0)]
    target = spark.createDataFrame([(0,), (10,)], "doc_id long")
    found = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(spark.createDataFrame(rows, DOC), target).collect()}
    assert found[10] < found[11] < found[12] and found[12] > 0


def test_blocks_give_the_same_losses(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 50, f"word{i % 7} w{i} again word{i % 3}", None, None, 0) for i in range(300)] + [(None, "no id", None, None, 0)] * 2, DOC)
    target = spark.createDataFrame([(i,) for i in range(0, 50, 3)], "doc_id long")
    one = sorted(map(str, lm_score.cross_entropy_difference(rows, target).selectExpr("doc_id", "n_tokens", "round(target_loss, 9)", "round(background_loss, 9)").collect()))
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 3000)
    assert one == sorted(map(str, lm_score.cross_entropy_difference(rows, target).selectExpr("doc_id", "n_tokens", "round(target_loss, 9)", "round(background_loss, 9)").collect()))


def test_chat_examples(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|role:user|>\n<!|x <!!|", "<<SYS>> [!/INST] <!/s>", "", None, "plain"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(1, 6, "odd|>role<|", "tail"), (2, 0, None, None), (None, 0, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    examples = chat.expand_prefix_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)))
    own = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [r["trainable"] for r in own] == [True, True, True, False]
    for r, reply in zip(own, (texts[1], texts[3], texts[5]), strict=False):
        part = r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]]
        assert examples.sparkSession.createDataFrame([(part,)], "t string").select(chat.unescape(F.col("t"))).first()[0] == reply
    found = {r["conv_id"]: r for r in chat.digest_examples(examples).collect()}
    said = "".join(f"{a}\n{t or ''}\n" for _, _, a, t in rows[:7])
    assert found[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[1]["n_turns"] == 7
    assert found[1]["loss_sha256"] == hashlib.sha256((texts[1] + texts[5]).encode()).hexdigest()
    assert found[2]["loss_chars"] == 0 and found[None]["n_turns"] == 1 and found[3]["loss_chars"] == 8
    assert chat.expand_prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice(["<", "|", "!", "[", "/", "INST]", "s>", "SYS>>", "a", ">", "\n"]) for _ in range(12)) for _ in range(800)]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect()
    assert all(r["t"] == r["u"] == r["r"] and "<|" not in r["e"] and "</s>" not in r["e"] and "[/INST]" not in r["e"] for r in rows)


def test_urls(spark):
    rows = [(1, "http://a.com/en/1"), (2, "http://X.Example.COM/en/71?q"), (3, "http://a.net/de/8"), (4, "http://example.net/de/81"), (5, "http://acom/en/"), (6, None), (7, "nothing"), (8, "http://com"), (9, "s://casino-jackpot.example.co/x"), (10, "https://library.example.fr/x"), (10, "https://library.example.fr/x")]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("hit", F.lit(1)), urls.labelled_urls(spark)).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == 11
    assert found[1] == ("a.com", "/en/1", "com/en/", "block") and found[2] == ("x.example.com", "/en/71", "example.com/en/7", "allow")
    assert found[3][2:] == ("net/de/", "allow") and found[4][2:] == ("example.net/de/8", "block") and found[5][2] is None
    assert found[6] == ("", "", None, "allow") == found[7] and found[8][:3] == ("com", "", None)
    assert found[9][3] == "block" and found[10][3] == "allow"


def test_url_model_equals_a_plain_loop_and_knows_held_out_urls(spark):
    import math

    table = urls.labelled_urls(spark).withColumn("url", F.col("url")).collect()
    held = {r["url"] for r in table if hashlib.md5(r["url"].encode()).digest()[0] % 4 == 0}
    fitted = spark.createDataFrame([r for r in table if r["url"] not in held] + [("https://nolabel.net", None)], "url string, label double")
    asked = spark.createDataFrame([(i, r["url"]) for i, r in enumerate(table)], "page_id long, url string")
    found = {r["page_id"]: r["probability"] for r in urls.filter_urls(asked, fitted, rules=()).collect()}
    weights, intercept = urls.fit_url_model(fitted)
    for i, r in enumerate(table):
        host, slash, path = r["url"].partition("://")[2].partition("/")
        parts = [(kind + text[p : p + n]) for kind, text in (("h", f"^{host}$"), ("p", f"^{(slash + path).split('?')[0]}$")) for n in urls.SIZES for p in range(len(text) - n + 1)]
        hashed = spark.createDataFrame([(x,) for x in set(parts)], "g string").select(F.pmod(F.xxhash64("g"), F.lit(urls.BUCKETS)).alias("b")).distinct().collect() if i % 40 == 0 else None
        if hashed is not None:
            assert found[i] == pytest.approx(1 / (1 + math.exp(-intercept - sum(weights[h["b"]] for h in hashed))), abs=1e-6)
    hits = Counter((r["label"], found[i] >= 0.5) for i, r in enumerate(table) if r["url"] in held)
    assert len(held) > 40 and hits[1, True] / (hits[1, True] + hits[1, False]) > 0.7 and hits[1, True] / (hits[1, True] + hits[0, True]) > 0.8, hits
    print("held-out urls", hits)


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.filter_urls(none, urls.labelled_urls(spark)).count() == 0
    clash = spark.createDataFrame([(1, "x://" + "a" * 50_000 + "/" + "b/" * 50_000), (None, None)], "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "probability", "hit")})
    assert urls.filter_urls(clash, urls.labelled_urls(spark)).count() == 2


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    rows, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit_toxicity(rows, labels)
    table = toxicity.score_toxicity(rows, model).join(labels, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in table}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7 and n.get((0, 1), 0) / n[0, 0] < 0.05


def test_deobfuscation_and_edges(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" you scum moron idiot" if i % 2 else " you fine people"), None, None, 0) for i in range(400)]
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, DOC), labels)
    assert {"scum", "moron", "idiot"} <= model.lexicon.keys()
    restorer = toxicity.Restorer(model.chars, model.keep)
    for text in ("m0r0n", "an 1d10t!", "s c u m", "m-o-r-o-n", "sssscum", "$cum", "i d i o t.", "1d!ot"):
        assert restorer.read(text), text
    for text in ("plain words", "a b c d e", "555-0199", "+1 (2) 3", ""):
        assert not restorer.read(text), text
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.fit_toxicity(none, labels.limit(0))
    assert toxicity.score_toxicity(odd, empty).filter("predicted = 1").count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns


def test_words_that_share_a_beginning_are_told_apart(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    mixed = lambda *more: " ".join(rng.sample([*(rng.choice(words) for _ in range(40)), *more], 40 + len(more)))
    rows = [(i, mixed("scumbling") if i % 3 else mixed(rng.choice(("scumbag", "scumball", "scumbags")), *["scumbag"] * (i % 2)), None, None, 0) for i in range(600)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, DOC), labels)
    restorer = toxicity.Restorer(model.chars, model.keep)
    assert model.score(restorer, "you scumbags") > 0.7 and model.score(restorer, "the scumbling painters") < 0.5, model.lexicon
    assert model.score(restorer, "you scumbarrel") > 0.7  # not known: judged by its beginning
    assert "scumba" in model.lexicon


def test_caches_of_any_size_give_the_same_scores(monkeypatch):
    rng = random.Random(5)
    chars = toxicity.CharModel(Counter(g for w in ("idiot", "letter", "little", "boost") for g in toxicity.char_grams(w)))
    model = toxicity.ToxicityModel(chars, {"idiot": (2.0, 3.0, 0.0)}, -3.0)
    texts = ["", "1d10t i.d.i.o.t", *(" ".join("".join(rng.choice("idotle013.") for _ in range(rng.randrange(1, 9))) for _ in range(30)) for _ in range(40))]
    scores = lambda: [model.score(restorer, t) for t in texts]
    restorer = toxicity.Restorer(chars, model.keep)
    whole = scores()
    assert len(set(whole)) > 1 and restorer["letter"] is toxicity.NOTHING
    monkeypatch.setattr(toxicity, "MOST_KNOWN", 7)
    monkeypatch.setattr(toxicity, "MOST_CACHED", 5)
    chars.known.clear()
    restorer = toxicity.Restorer(chars, model.keep)
    assert scores() == whole and len(chars.known) <= 7 and len(restorer) <= 5


def test_viterbi_finds_the_best_of_all_readings(spark):
    """Against the enumeration of all readings of tokens of up to eight characters."""
    import math

    rng = random.Random(11)
    words = ["idiot", "moron", "scum", "letter", "slot", "tools", "little", "boost"]
    model = toxicity.CharModel(Counter(g for w in words for g in toxicity.char_grams(w) for _ in range(30)))
    for _ in range(150):
        token = "".join(rng.choice("iotmrnscule013$!.-_@") for _ in range(rng.randrange(2, 9)))
        best = {}
        for spaced in (False, True):
            paths = [("", 0.0)]
            for reads in toxicity.lattice(token):
                paths = [(text + gap + read, score + cost + (toxicity.CHANNEL["space"] if gap else 0)) for text, score in paths for gap in (["", "^"] if spaced and text and not text.endswith("^") else [""]) for read, cost in reads]

            def total(text, score):
                state, out = "^^^", score
                for c in text + "^":
                    out += model.log(state, c)
                    state = "^^^" if c == "^" else state[1:] + c
                return out

            best[spaced] = max((total(*p), p[0]) for p in paths)
            said = toxicity.decode(token, model, spaced)
            again = max((total(*p) for p in paths if [w for w in p[0].split("^") if w] == said), default=-math.inf)
            assert again == pytest.approx(best[spaced][0], abs=1e-9), (token, said, best[spaced])


def test_long_tokens_and_all_letters_are_read(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40)) + (" you scum moron idiot" if i % 2 else " you fine people"), None, None, 0) for i in range(400)]
    rows.append((None, "слово donaudampfschifffahrtsgesellschaft", None, None, 0))  # no label
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, DOC), labels)
    assert model.chars.counts["слов"] == model.chars.counts["damp"] == 1
    restorer = toxicity.Restorer(model.chars, model.keep)
    clean = "you,fine_people/" + ",".join(words[:20])
    for text in ("m" + "-" * 30 + "o-_-_-r" + "." * 30 + "o-n", f"{clean},m0r0n,{clean}", f"{clean}_1d10t", f"{clean}/m.o.r.o.n/{clean}", "fine,m0r0n", f"{clean},m_o_r_o_n,{clean}"):
        assert restorer.read(text), text
    assert not restorer.read(clean * 20)


def test_leaks_equal_brute_force(spark, odd, none):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in bench.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).select("doc_id", "text").collect()]
    first = bench.first()["text"]
    rows += [(90_001, "x " * 300 + first + " y" * 300), (90_002, first.upper()), (90_003, " ".join(first.split()[:6]))]
    want = set()
    for d, text in rows:
        own = set(decontam.item_shingles(decontam.words_of(text or ""), 5))
        for i, w in items.items():
            hit = [s in own for s in decontam.item_shingles(w, 5)]
            cut = max(0, 2 * len(w) // 3 - 4)
            if 100 * sum(hit) >= 80 * len(hit) and 2 * sum(hit[:cut]) >= cut and 2 * sum(hit[cut:]) >= len(hit) - cut:
                want.add((d, i))
    found = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and {d for d, _ in want} >= {90_001, 90_002}
    assert decontam.contaminated(none, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.contaminated(odd, bench).count() == 0
    kept = decontam.drop_contaminated(odd.unionByName(spark.createDataFrame([(None, first, None, None, 0), (1, "x " + first, None, None, 0)], DOC), allowMissingColumns=True), bench)
    assert kept.count() == len(ODD) and kept.columns == odd.columns and decontam.drop_contaminated(odd, bench.limit(0)).count() == len(ODD)


@pytest.mark.parametrize(("n_items", "n_words", "entries"), [(30, 80, 4_000_000), (400, 300, 500), (20_000, 5000, 4_000_000)])
def test_pruning_loses_nothing(monkeypatch, n_items, n_words, entries):
    import numpy as np

    monkeypatch.setattr(decontam, "BATCH_ENTRIES", entries)
    rng = random.Random(8)
    word = lambda: f"w{int(n_words * rng.random() ** 2)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(5, 20)))) for i in range(n_items)]
    df = Counter(w for _, t in items for w in set(decontam.words_of(t)))
    index = decontam.build_index(items, df, n_items, 12.0, 5)
    texts = [" ".join(word() for _ in range(rng.randrange(1, 120))) + " new " + rng.choice(items)[1] for _ in range(40)] + [" ".join(word() for _ in range(20_000))] * (n_items > 1000)
    ids = [np.array([index.terms.get(w.encode(), -1) for w in t.split()]) for t in texts]
    found = decontam.retrieve(index, ids)
    dense, half, want = np.zeros((len(index.terms), len(index.item_ids)), np.float32), index.window // 2, {}
    for t in range(len(index.terms)):
        for at in range(index.starts[t], index.starts[t + 1]):
            dense[t, index.items[at]] = index.weights[at]
    for i, x in enumerate(ids):
        for p in range(0, max(1, len(x)), half):
            score = dense[sorted({int(t) for t in x[p : p + 2 * half] if t >= 0})].sum(axis=0)
            for at in np.flatnonzero(score >= 1 - 1e-6):
                want[i, int(at)] = max(want.get((i, int(at)), 0.0), float(score[at] * index.shares[at]))
    assert found.keys() == want.keys() and len(found) >= 40 and all(found[k] == pytest.approx(want[k], rel=1e-4) for k in want)


def test_no_matching_item_is_below_its_threshold():
    """All ways to break words of an item so that 80 % of its shingles stay leave at least its threshold."""
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(60):
        n, k = rng.randrange(1, 13), 5
        weights = [rng.choice((0.1, 1.0, 9.0)) for _ in range(n)]
        size, spare = min(k, n), rng.randrange(3)
        worst = 0.0
        for m in range(n + 1):
            for lost in combinations(range(n), m):
                broken = {s for s in range(n - size + 1) if any(s <= i < s + size for i in lost)}
                if len(broken) <= spare:
                    worst = max(worst, sum(weights[i] for i in lost))
        assert decontam.most_lost(weights, k, spare) == pytest.approx(worst)


def check_packing(rows, texts):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(by_sequence)


def test_packing(spark, odd, none):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs(spark)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs(spark).collect()}
    bins = check_packing(rows, texts)
    assert bins <= 1.02 * sum(r["length"] for r in rows) / packing.CAPACITY + 1
    t = Tokenizer.from_file(packing.default_tokenizer())
    for d, text in list(texts.items())[:40]:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        for r in (r for r in rows if r["doc_id"] == d):
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    edge = packing.pack_documents(odd).collect()
    check_packing(edge, {})
    assert sorted(r["length"] for r in edge if r["doc_id"] in (1, 2)) == [1, 1] and packing.pack_documents(none).count() == 0


def test_encoder_equals_the_tokenizer():
    import numpy as np

    e = packing.Encoder(packing.default_tokenizer())
    rng = random.Random(7)
    odd = ["a  b", " a", "a ", "a\n\nb c", "x .\ny", "don't stop.", "a \n b", "1,2. x", "é|è;: z", "\xa0a b", "a\tb", "<|endoftext|> x", "", "a\0b c", "\0", "b.\nC d,\n"]
    odd += ["".join(rng.choice(["a", "Bc", " ", "\n", ".", ",", "'s", "7", "é", "\t", "|"]) for _ in range(20)) for _ in range(300)]
    want = [np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in odd]
    assert e.encode(odd) == want == e.encode(odd)


def test_dominance_and_best_fit_hold_every_item():
    rng = random.Random(9)
    for _ in range(200):
        counts = Counter(rng.randrange(1, 101) for _ in range(rng.randrange(1, 120)))
        plan = packing.plan_bins(dict(counts), 100)
        held = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 100 and times > 0
            for x in pattern:
                held[x] += times
        assert held == counts
        rooms = []  # best-fit decreasing, item by item
        for x in sorted(counts.elements(), reverse=True):
            at = min((i for i, room in enumerate(rooms) if room >= x), key=lambda i: rooms[i], default=None)
            if at is None:
                rooms.append(100 - x)
            else:
                rooms[at] -= x
        assert sum(n for _, n in plan) <= len(rooms)


def test_fixed_bins_are_those_of_a_best_packing():
    """Fixed bins and the exhaustive best of the rest are as few as the exhaustive best of all."""
    rng = random.Random(5)

    def fewest(items, capacity=100):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for room in set(rooms):
                if room >= items[i]:
                    at = rooms.index(room)
                    go(i + 1, [*rooms[:at], room - items[i], *rooms[at + 1 :]])
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return best[0]

    assert packing.plan_bins({10: 1, 15: 1, 70: 1}, 100) in ([((70, 15, 10), 1)], [((70, 10, 15), 1)])
    for i in range(500):
        items = [rng.randrange(1, 101) if i % 2 else rng.choice((10, 15, 20, 30, 35, 50, 70)) for _ in range(rng.randrange(1, 10))]
        fixed, left = packing.reduce_by_dominance(Counter(items), 100)
        assert Counter(x for p, n in fixed for x in p * n) + Counter(left) == Counter(items)
        assert sum(n for _, n in fixed) + fewest(list(Counter(left).elements())) == fewest(items)


def test_language_evidence(spark, odd, none):
    rows = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    langs, models = langid.fit_text_models(rows.filter(~third))
    found = langid.identify_languages(langid.document_rows(rows), langs, models).join(rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("said"), "n_chars"), "id")
    held = found.filter("crc32(CAST(id AS STRING)) % 3 = 1 AND n_chars > 40")
    assert held.filter("lang = said").count() / held.count() > 0.97
    pages = spark.createDataFrame([(1, "http://x.fr/fr/1", '<html lang="fr"><p></p></html>'), (2, None, None), (3, "http://x.fr/fr/1", "<p>der die das und nicht eine</p>")], PAGE)
    many = spark.createDataFrame([(100 + i, f"http://a{i % 3}.fr/fr/{i}", '<html lang="fr">le la les des une pour dans que qui</html>') for i in range(40)], PAGE)
    out = {r["id"]: r["lang"] for r in langid.identify_languages(langid.page_rows(pages.unionByName(many)), langs, models).collect()}
    assert out[1] == "fr" and out[2] is not None
    assert langid.identify_languages(langid.document_rows(odd), langs, models).count() == len(ODD)
    assert langid.identify_languages(langid.page_rows(pages.limit(0)).unionByName(langid.document_rows(none)), langs, models).count() == 0
    clash = langid.page_rows(pages.withColumns({c: F.lit("x") for c in ("host", "domain", "lang", "ll", "best", "id", "kind")}).withColumn("html", F.concat("html", F.repeat(F.lit("a <!-- <script <"), F.lit(50_000)))))
    assert langid.identify_languages(clash, langs, models).count() == 3
    nothing = langid.identify_languages(langid.document_rows(odd), *langid.fit_text_models(none))
    assert nothing.count() == len(ODD) and nothing.filter("lang IS NOT NULL OR posterior IS NOT NULL OR text_lang IS NOT NULL").count() == 0


def test_scripts_are_told_apart(spark):
    said = {"ru": "это простой русский текст без смысла", "bg": "това е прост български текст без смисъл", "el": "αυτό είναι ένα απλό κείμενο", "ar": "هذا نص عربي بسيط", "zh": "这是一个简单的中文文本", "ja": "これは簡単な日本語の文です", "he": "זה טקסט פשוט בעברית"}
    rows = spark.createDataFrame([(10 * i + j, t, lang, None, 0) for i, (lang, t) in enumerate(said.items()) for j in range(3)], DOC)
    langs, models = langid.fit_text_models(rows)
    asked = spark.createDataFrame([(i, " ".join(t.split()[1:]) or t[3:], None, None, 0) for i, t in enumerate(said.values())], DOC)
    found = {r["id"]: r["text_lang"] for r in langid.identify_languages(langid.document_rows(asked), langs, models).collect()}
    assert found == dict(enumerate(said))


def test_visible_text():
    assert langid.visible_text("<p>a</p>b<script>x<y</SCRIPT >c<!-- d > -->e<style>z</style>f") == " a b c e f"
    assert langid.visible_text("a <!-- b <b>c < d") == "a  c < d" and langid.visible_text("x<script>y") == "x y" and langid.visible_text("") == ""


def test_posteriors_equal_a_plain_loop(spark):
    import math

    table = [r.asDict() for r in langid.document_rows(docs(spark)).unionByName(langid.page_rows(spark.read.parquet(f"{SF}/pages.parquet"))).collect()]
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    langs = sorted({r["lang"] for r in rows if r["lang"]})
    n = len(langs)

    def grams(text):
        x = [ord(c) if c.isalpha() else 0 for c in "  " + text.lower() + "  "]
        return [tuple(x[i : i + 3]) for i in range(len(x) - 2)] + [(0, 0, c, 0) for c in x[2:]]

    counts = [Counter() for _ in langs]
    for r in rows:
        if r["lang"] and r["text"] is not None:
            counts[langs.index(r["lang"])].update(langid.bucket(g) for g in grams(r["text"]))
    sums = [sum(c.values()) for c in counts]
    logs = lambda lang, g: math.log((counts[lang][g] + langid.ADDED) / (sums[lang] + langid.ADDED * langid.GRAMS))
    for r in table:
        text = (langid.visible_text(r["body"] or "") if r["kind"] == "page" else r["body"]) or ""
        own = [langid.bucket(g) for g in grams(text)]
        ll = [langid.TEMPER * sum(logs(x, g) for g in own) for x in range(n)] if text.strip() else [0.0] * n
        r["ll"] = [max(x - max(ll), -langid.MOST_NATS) for x in ll]
        r["best"] = r["ll"].index(0.0) if min(r["ll"]) < 0 else None
    known = [r for r in table if r["best"] is not None]
    shares = lambda test: [float(sum(r["best"] == x for r in known if test(r))) for x in range(n)]
    overall = shares(lambda r: True)
    cache = {}

    def of(*keys, row):
        values = tuple(row[k] for k in keys)
        if None in values:
            return None
        if (keys, values) not in cache:
            own = shares(lambda r: tuple(r[k] for k in keys) == values)
            cache[keys, values] = own if sum(own) else None
        return cache[keys, values]

    found = {(r["kind"], r["id"]): r for r in langid.identify_languages(langid.document_rows(docs(spark)).unionByName(langid.page_rows(spark.read.parquet(f"{SF}/pages.parquet"))), *langid.fit_text_models(docs(spark))).collect()}
    assert len(found) == len(table)
    for r in table:
        less = lambda x: [max(0.0, v - (i == r["best"])) for i, v in enumerate(x or [0.0] * n)]  # noqa: B023, E731
        mixed = lambda own, prior: [(a + langid.SMOOTHING * p) / (sum(own) + langid.SMOOTHING) for a, p in zip(own, prior, strict=True)]
        whole = [(x + 1) / (sum(overall) + n) for x in overall]
        host = mixed(less(of("host", "domain", row=r)), mixed(less(of("domain", row=r)), whole))
        post = [a + math.log(b) for a, b in zip(r["ll"], host, strict=True)]
        for k in langid.EVIDENCE:
            if (own := of(k, row=r)) is not None:
                post = [a + math.log((v + 0.5) / (o + 1)) for a, v, o in zip(post, less(own), overall, strict=True)]
        top = max(post)
        got = found[r["kind"], r["id"]]
        assert got["posterior"] == pytest.approx(1 / sum(math.exp(x - top) for x in post), abs=1e-6)
        assert got["lang"] == langs[post.index(top)] or sorted(post)[-2] > top - 1e-9
        assert got["text_lang"] == (None if r["best"] is None else langs[r["best"]])


def plain_quality(text):
    """Whether a text passes the rules, by plain loops."""
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline as p

    rows = docs(spark)
    kept = common.materialize(p.toxicity_stage(spark, rows, SF))
    model = toxicity.fit_toxicity(rows, spark.read.parquet(f"{SF}/labels.parquet"))
    restorer = toxicity.Restorer(model.chars, model.keep)
    left = {r["doc_id"]: r for r in rows.collect() if model.score(restorer, r["text"] or "") < 0.7}
    assert {r["doc_id"] for r in kept.collect()} == left.keys() and kept.columns == rows.columns
    kept = common.materialize(p.quality_stage(spark, kept, SF))
    ids = {i for i, r in left.items() if plain_quality(r["text"])}  # no source here is far worse than the others
    assert {r["doc_id"] for r in kept.collect()} == ids and kept.columns == rows.columns
    kept = common.materialize(p.near_duplicate_stage(spark, kept, SF))
    groups = brute_links(shingle_sets([(i, left[i]["text"]) for i in ids], 5), 80)
    ids = {i for i in ids if groups[i][1] == i}
    assert {r["doc_id"] for r in kept.collect()} == ids and kept.columns == rows.columns
    kept = common.materialize(p.decontamination_stage(spark, kept, SF))
    items = [decontam.item_shingles(decontam.words_of(r["text"]), 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in ids if not any(sum(s in own for s in x) >= 0.8 * len(x) for own in [set(decontam.item_shingles(decontam.words_of(left[i]["text"]), 5))] for x in items)}
    assert {r["doc_id"] for r in kept.collect()} == clean and kept.columns == rows.columns
    assert {r["doc_id"] for r in p.packing_stage(spark, kept, SF).collect()} == clean == {r["doc_id"] for r in p.run(spark, SF).collect()}


def test_pipeline_judges_rows(spark, odd):
    """Rows without an id, of repeated ids, and with no text; the fate of each is that of its own text."""
    import corpus_pipeline as p

    good = [" ".join(f"{a}{i}" for i in range(40)) for a in "abc"]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    item = good[2] + " " + leak
    rows = [(None, good[0], "en", "s", 0), (None, "short", "en", "s", 0), (1, good[1], "en", "s", 0), (1, "short", "en", "s", 0), (1, good[0] + " end", "en", None, 0), (2, good[1], "en", "s", 0), (None, item, "en", "s", 0), (2, item, "en", "s", 0)]
    frame = spark.createDataFrame(rows, DOC)
    texts = lambda stage, x: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in stage(spark, x, SF).collect()))
    said = lambda keep: sorted(((r[0] is None, r[0] or 0, r[1] or "") for i, r in enumerate(rows) if i in keep))
    assert texts(p.quality_stage, frame) == said({0, 2, 4, 5, 6, 7})
    assert texts(p.near_duplicate_stage, frame) == said({2, 3, 4, 7})  # ids before none, the smallest first
    assert texts(p.decontamination_stage, frame) == said({0, 1, 2, 3, 4, 5})
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    counts = {name: stage(spark, plain, SF).count() for name, stage in p.STAGES}
    pieces = counts.pop("packing")
    assert counts == {"toxicity": len(ODD), "quality_rules": 0, "near_duplicates": len(ODD) - 1, "decontamination": len(ODD)} and pieces >= len(ODD)
    assert all(stage(spark, plain.limit(0), SF).count() == 0 for _, stage in p.STAGES)


def test_items_of_one_template_are_found_by_their_common_part(spark):
    """Two thousand items whose only rare words stand at one end: a text with the common part meets the rule for all."""
    rng = random.Random(6)
    template = "which of the given answers is right for the question about a town on the river in the north"
    items = spark.createDataFrame([(i, f"zq{i}x {template}") for i in range(2000)], "item_id long, text string")
    noise = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    docs = spark.createDataFrame([(1, f"{noise} {template} {noise}"), (2, noise), (3, f"zq7x {noise}")], "doc_id long, text string")
    found = decontam.contaminated(docs, items).collect()
    assert {r.doc_id for r in found} == {1} and {r.item_id for r in found} == set(range(2000))
    words = template.split()
    assert all(r.n_shingles == len(words) - 3 and r.n_matched == len(words) - 4 for r in found)


def test_row_numbers_hold_for_any_split_of_the_scan(spark):
    """The near-duplicate stage gives the same rows when its input is scanned in other parts."""
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(60)]
    rows = [(i, texts[i % 60] if i < 90 else " ".join(f"v{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stored = common.materialize(docs.repartition(5))
    seen = []
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.files.minPartitionNum", parts)
        try:
            out = corpus_pipeline.near_duplicate_stage(spark, stored, "")
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
        spark.conf.set("spark.sql.files.minPartitionNum", "3" if parts == "1" else "1")  # read in other parts than planned
        seen.append(sorted(r.doc_id for r in out.collect()))
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    assert seen[0] == seen[1] == [*range(60), *range(90, 140)]


def test_chunks_of_any_length_are_encoded_alike():
    encoder = packing.Encoder(packing.default_tokenizer())
    encoder.MOST = 50
    rng = random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("ab  \n漢字é.") for _ in range(rng.choice([0, 3, 30, 300]))) + "x" * rng.choice([0, 47, 48, 49, 200]) for _ in range(20)]
        want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.encode(texts) == want
        assert all(len(x) <= encoder.SHORT for x in (*encoder.first, *encoder.later))
