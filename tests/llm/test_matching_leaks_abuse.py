import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.llm import abuse, leaks, matching
from kinsieve.llm.plaintext import plain

PATCH = "diff --git a/lib/x_{0}.c b/lib/x_{0}.c\nindex {0:07x}..{1:07x}\n--- a/lib/x_{0}.c\n+++ b/lib/x_{0}.c\n@@ -1,3 +1,3 @@\n context\n-\tif (value_{0} > {1}) return -{0};\n+\tassert(value_{0} != 0x{1:04x});\n+\tmemcpy(target_{0}, source_{1}, {0});\n"
REPORT = "==1==ERROR: AddressSanitizer: heap-use-after-free on address\n    #0 0x1a in crash_fn_{0} /src/p/lib/x.c:1:2\nSUMMARY: AddressSanitizer: heap-use-after-free /src/p/lib/x.c:1 in crash_fn_{0}\n"


def fixes(spark, n=40):
    sec = [(i, f"proj{i % 4}.ossfuzz-{i}", "From abc\nSubject: x\n\n" + PATCH.format(i, i + 5000).replace("\n", "\r\n"), REPORT.format(i), "c") for i in range(n)]
    swe = [(1000 + i, f"o__proj{i % 4}-{i}", f"o/Proj{i % 4}", None, PATCH.format(i, i + 5000).replace("\t", "    "), f"crash_fn_{i} crashes. More.", "c") for i in range(n)]
    swe += [(3000 + i, f"o__proj{i % 4}-9{i}", f"o/proj{i % 4}", None, PATCH.format(i, i + 9000), f"crash_fn_{i} once more. Another change", "c") for i in range(n)]
    sec += [(900, None, None, None, None), (901, "", "", "", None), (902, *sec[0][1:])]
    swe += [(5000, None, None, None, None, None, None), (5001, *swe[0][1:]), (5002, "o__proj1-7", "o/proj1", None, None, "crash_fn_1 crashes. Text", "c")]
    a = spark.createDataFrame(sec, "sec_id long, instance_id string, patch string, sanitizer_report string, sig string")
    return a, spark.createDataFrame(swe, "row_id long, instance_id string, repo string, base_commit string, patch string, problem_statement string, body string")


def test_same_fix(spark):
    a, b = fixes(spark)
    rows = matching.same_fix(a, b).collect()
    got = {(r.sec_id, r.row_id) for r in rows}
    want = {(i, 1000 + i) for i in range(40)} | {(902, 1000), (0, 5001), (902, 5001)}
    assert len(rows) == len(got) and want <= got and got - want <= {(1, 5002)}
    assert all(0.5 <= r.confidence <= 1 for r in rows)
    assert matching.same_fix(a.limit(0), b).count() == 0 and matching.same_fix(a, b.limit(0)).count() == 0


def test_hot_blocks_are_divided(spark):
    a, b = fixes(spark)
    shared = "+\tregister_handler(default_context, 4711);\n"  # a line that all patches have
    a, b = (d.withColumn("patch", F.concat("patch", F.lit(shared))) for d in (a, b))
    whole = {(r.sec_id, r.row_id) for r in matching.same_fix(a, b).collect()}
    divided = {(r.sec_id, r.row_id) for r in matching.same_fix(a, b, hot_pairs=30).collect()}
    assert divided == whole and {(i, 1000 + i) for i in range(40)} <= divided


def test_patch_parts():
    p = matching.parse_patch("# applies on top of 39182082bf8f\n" + PATCH.format(1, 2))
    assert p["base"] == "39182082bf8f" and p["files"] == ["x_1.c"] and p["blobs"] == {"x_1.c": ["0000001", "0000002"]} and len(p["lines"]) == 3
    assert matching.parse_patch(None)["lines"] == [] and matching.crash_functions(None) == ([], "") and matching.title_functions("") == ([], "")
    assert matching.crash_functions("\x1b[1m" + REPORT.format(3).upper()) == (["crash_fn_3"], "heap use after free")


def test_classifier_is_calibrated():
    rng = np.random.default_rng(0)
    x = np.zeros((2000, len(matching.FEATURES)))
    same = rng.random(2000) < 0.5
    x[:, 0] = np.where(same, rng.uniform(0.7, 1, 2000), rng.uniform(0, 0.15, 2000))
    x[:, 2], x[:, matching.FEATURES.index("project")] = np.where(same, 2.5, 0.7), 1.0
    w = matching.fit(x)
    p = 1 / (1 + np.exp(-(np.hstack([x, np.ones((2000, 1))]) @ w)))
    assert ((p > 0.5) == same).mean() > 0.99
    assert matching.fit(x[same]) is None and matching.fit(np.empty((0, len(matching.FEATURES)))) is None
    few = matching.fit(np.vstack([x[same][:2], x[~same][:2]]))  # any labels of both kinds teach something
    assert few is not None and np.hstack([x[same].mean(axis=0), 1]) @ few > np.hstack([x[~same].mean(axis=0), 1]) @ few
    table = matching.reliability(x, np.ones(2000), np.arange(2000))
    assert sum(n for _, _, n, _, _ in table) > 300 and all(abs(p - y) < 0.1 for _, _, _, p, y in table)


def test_without_labels_confidence_is_null(spark):
    a, b = fixes(spark, 3)
    rows = matching.same_fix(a.where("sec_id < 3"), b.where("row_id < 1003")).collect()
    assert {(r.sec_id, r.row_id, r.confidence) for r in rows} == {(i, 1000 + i, None) for i in range(3)}


ITEM = "when reader_{0} meets its {0}th stale cookie it forgets vertex_{0} and starts over at slot_{0} although buffer_{0} still holds {0}77 bytes of frozen data from the union_{0} pool"


def test_leaks(spark):
    items = spark.createDataFrame([(i, ITEM.format(i + 10), "x") for i in range(12)] + [(90, None, "x"), (91, "", "x")], "item_id long, text string, doc_id string")
    words = ITEM.format(10).split()
    changed = [w if k not in (4, 12) else "other" for k, w in enumerate(words)]
    docs = [
        (1, "Intro text. " + ITEM.format(10) + " the end"), (2, "<p>Now " + " ".join(words[3:20]).upper().replace("_", "\\_") + "</p> fine"), (3, "noise before " + " ".join(changed) + " noise after"),
        (4, " ".join(words[:8])), (5, "a wholly different text about nothing at all that goes on for many words without any match"), (6, None), (7, ""), (8, "x " * 3000 + ITEM.format(13)),
        (9, ITEM.format(10).replace("o", "о").replace("e", "е") + " " + ITEM.format(11)), (10, ITEM.format(55)),
    ]
    rows = leaks.leaks(spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, words int"), items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 0), (2, 0), (3, 0), (8, 3), (9, 0), (9, 1)} and len(rows) == 6
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert leaks.leaks(empty, items).count() == 0
    assert leaks.leaks(empty, items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leaks(empty, items, most_items=3)


def test_search_recall_against_brute_force(spark, sf_dir):
    """Latent candidates lose no more than a fiftieth of what checking every document against every item finds."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "eval_items"))
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()}
    known = leaks.Items([(r.item_id, r.text) for r in items.collect()])
    part = next(known.parts())
    want = set()
    for r in docs.where("text <> ''").collect():
        ids = part.local[np.array([known.number.get(w, -1) for w in leaks._WORD.findall(plain(r.text))], np.int32)]
        for i in part.ids:
            if leaks._may_leak(part, i, ids) and leaks.leaked(part.ids[i], part.own[i], ids):
                want.add((r.doc_id, i))
    assert got <= want and len(got) >= 0.98 * len(want)
    small = [len(p.rows) for p in known.parts(200)]  # items in many parts give the same
    assert len(small) > 3 and {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, part_passages=200).collect()} == got


def test_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a, b = rng.integers(-1, 6, rng.integers(0, 15)).astype(np.int32), rng.integers(-1, 6, rng.integers(0, 15)).astype(np.int32)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] >= 0 else max(table[i, j + 1], table[i + 1, j])
        pairs = leaks.common_subsequence(a, b)
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_plain():
    assert plain("Thе fiх <b>A&amp;B</b> foo\\_bar line\\nNext Ｆｕｌｌ é ﬁ") == "the fix  a&b  foo_bar line next full e fi"


def held_out(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "review_labels"))
    return abuse.labelled(docs, labels)


def test_held_out_accuracy(spark, sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.1")
    rows = held_out(spark, folder)
    train, test = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    model = abuse.train([t for t, _ in train], [y for _, y in train])
    got = abuse.score(model, model.reader(), [t for t, _ in test])[0] >= 0.5
    want = np.array([y > 0.5 for _, y in test])
    assert (got == want).mean() > (0.8 if len(test) > 50 else 0.5)  # raters err in about a tenth


HARMLESS = ("please review the {0} patch before friday", "the {0} test fails after the second restart", "your {0} change is fine with me", "i am an author of {0} and it is slow", "a new reader for {0} landed", "we kill the {0} process when it hangs", "the rule against {0} insults bans the word idiot in chat")
ABUSIVE = ("you are an idiot and a loser who broke {0}", "go away you worthless loser and leave {0}", "only an idiot would write {0} like you", "shut up you worthless idiot about {0}")


def made(n, seed):
    """(texts, labels as raters give them, truth): a tenth of the labels is wrong, and names are new in every document."""
    rng = np.random.default_rng(seed)
    texts, labels, truth = [], [], []
    for i in range(n):
        said = [HARMLESS[k].format(f"name{seed}x{i}") for k in rng.integers(0, len(HARMLESS), 4)]
        bad = rng.random() < 0.3
        if bad:
            said[rng.integers(4)] = ABUSIVE[rng.integers(len(ABUSIVE))].format(f"name{seed}x{i}")
        texts.append(". ".join(said) + "."), truth.append(bad), labels.append(float(bad != (rng.random() < 0.1)))
    return texts, labels, np.array(truth)


def test_learning_from_wrong_labels():
    """Nothing but noisy document labels teaches the model; sentences that quote a word or use it otherwise stay harmless."""
    texts, labels, _ = made(600, 1)
    model = abuse.train(texts, labels)
    fresh, _, truth = made(600, 2)
    score, offending, worst, _ = abuse.score(model, model.reader(), fresh)
    got = score >= 0.5
    assert (got & truth).sum() >= 0.97 * truth.sum() and (got & truth).sum() >= 0.97 * got.sum()
    assert all(any(w.startswith(a.split("{")[0][:12]) for a in ABUSIVE) for w, t in zip(worst, truth & got) if t) and (offending[truth & got] == 1).all()


def test_disguises():
    texts, labels, _ = made(600, 1)
    reader = abuse.train(texts, labels).reader()
    open_ = [n for n in reader("you are an idiot and a loser") if n]
    assert len(open_) == 7
    for text in ("you are an 1d10t and a l053r", "you are an i.d.i.o.t and a l o s e r", "you are an idddiot and a losssser", "you are an idiot and a l***r", "you аrе an idiоt and a los​er"):
        assert [n for n in reader(abuse.clear_text(text)) if n] == open_, text


def test_scores_of_odd_tables(spark):
    texts, labels, _ = made(600, 1)
    taught = [(1000 + i, t, "c") for i, t in enumerate(texts)]
    docs = [(1, "You worthless loser, you are an idiot.", "A"), (2, "Please fix the build. It breaks often.", "a-"), (3, None, None), (4, "", "b"), (5, "... !!", "b"), (6, "fine. " * 20_000 + "Go away you worthless idiot.", "b")]
    schema = "doc_id long, text string, source string, score double"
    df = spark.createDataFrame([(*d, 0.0) for d in docs], schema)
    every = df.unionByName(spark.createDataFrame([(*d, 0.0) for d in taught], schema))
    raters = [(1, "r", None), (2, "r", 0), (2, "s", 1), (77, "r", 1)]
    known = spark.createDataFrame([*raters, *((1000 + i, "r", int(y)) for i, y in enumerate(labels))], "doc_id long, rater string, toxic int")
    rows = {r.doc_id: r for r in abuse.scores(every, known, keep=("source",)).where("doc_id < 1000").collect()}
    assert len(rows) == 6 and rows[1].score > 0.5 and rows[6].score > 0.5 and rows[2].score < 0.5
    assert "worthless" in rows[6].worst and rows[3].score == rows[4].score == rows[5].score == 0 and rows[3].worst is None
    rates = {r.source: (r.documents, r.abusive) for r in abuse.rates(abuse.scores(every, known, keep=("source",)).where("doc_id < 1000")).collect()}
    assert rates == {"A": (1, 1), "a-": (1, 0), None: (1, 0), "b": (3, 1)}
    unknown = spark.createDataFrame(raters, "doc_id long, rater string, toxic int")  # no label is usable: nothing is known
    assert {r.score for r in abuse.scores(df, unknown).collect()} == {0.0}
    assert abuse.scores(df.limit(0), unknown.limit(0)).count() == 0


def test_divided_blocks_make_fewer_candidates(spark):
    rows = [(s, bytes([s, i]), [1, 100 + i], [7, 1000 + i]) for s in (0, 1) for i in range(40)] + [(s, bytes([s, 200]), [1], [7]) for s in (0, 1)]
    classes = spark.createDataFrame(rows, "side int, sig binary, keys array<long>, lines array<long>")
    pair = lambda df: {(bytes(r.a), bytes(r.b)) for r in df.collect()}
    assert len(pair(matching.candidates(classes))) == 41 * 41
    same = {(bytes([0, i]), bytes([1, i])) for i in (*range(40), 200)}
    assert pair(matching.candidates(classes, hot_pairs=100)) == same


def test_a_leak_in_a_third_of_the_documents(spark, sf_dir):
    """Copies of one leak, whole, in part or changed, are found however many there are, and so are other items' leaks."""
    docs, items = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "eval_items"))
    base = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("text <> ''").collect()]
    known = leaks.Items([(r.item_id, r.text) for r in items.collect()])
    hot = max((i for i in known.ids if len(known.ids[i]) <= 150), key=lambda i: (known.own[i].sum(), i))
    words, first = leaks._WORD.findall(plain(items.where(F.col("item_id") == hot).head().text)), 10**9
    copies = []
    for k in range(len(base) // 2):
        part = words if k % 3 == 0 else words[k % 40 : k % 40 + 30]
        part = [w if k % 3 < 2 or x % 10 != 9 else "other" for x, w in enumerate(part)]
        copies.append((first + k, f"note {k} " + " ".join(part) + f" end {k}"))
    want = {d for d, t in copies if leaks.leaked(known.ids[hot], known.own[hot], np.array([known.number.get(w, -1) for w in leaks._WORD.findall(plain(t))], np.int32))}
    schema = "doc_id long, text string"
    few = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(base, schema), items).collect()}
    many = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(base + copies, schema).repartition(4), items).collect()}
    got = {d for d, i in many if i == hot and d >= first}
    assert len(want) > 0.9 * len(copies) and len(got & want) >= 0.99 * len(want)
    assert few <= many


def test_all_pairs_of_hot_blocks_meet(spark):
    """Rows without a patch share a hot function alone with the other side, whose rows have something else."""
    report = REPORT.replace("SUMMARY", "    #1 0x1b in own_fn_{0} /src/p/lib/x.c:3:2\nSUMMARY").replace("crash_fn_{0}", "shared_fn")
    sec = [(i, f"proj.ossfuzz-{i}", None, report.format(i)) for i in range(40)]
    swe = [(1000 + i, f"o__proj-{i}", "o/proj", None, PATCH.format(i, i + 5000), f"shared_fn crashes for the {i}th time. More.") for i in range(30)]
    a = spark.createDataFrame(sec, "sec_id long, instance_id string, patch string, sanitizer_report string")
    b = spark.createDataFrame(swe, "row_id long, instance_id string, repo string, base_commit string, patch string, problem_statement string")
    rows = matching.same_fix(a, b, threshold=0.0, hot_pairs=30).collect()
    assert len(rows) == 1200 and {(r.sec_id, r.row_id) for r in rows} == {(i, 1000 + j) for i in range(40) for j in range(30)}


def test_cells_meet_each_pair_once(spark):
    rows = [(s, bytes([s, i]), [7, 8, 1000 + i]) for s in (0, 1) for i in range(40)]
    classes = spark.createDataFrame(rows, "side int, sig binary, keys array<long>")
    side = lambda k: classes.where(F.col("side") == k).select(F.explode("keys").alias("key"), "sig")
    hot = spark.createDataFrame([(7, 40, 40), (8, 40, 40)], "key long, m long, n long")
    got = [(bytes(r.a), bytes(r.b)) for r in matching._cells(side(0), side(1), hot, 100).collect()]
    assert len(got) == len(set(got)) == 1600


def test_functions_are_found_wherever_they_stand():
    """Short names for qualified ones, deep frames, and identifiers behind the first sentence make keys within a project."""
    frames = [*(f"helper_fn_{k}" for k in range(6)), "Dap::RemoteBatch::hashBatch(int*)"]
    report = "".join(f"    #{k} 0x1a in {f} /src/p/lib/x.c:{k}:2\n" for k, f in enumerate(frames))
    sec = matching.record(0, {"instance_id": "libproject.ossfuzz-1", "patch": None, "sanitizer_report": report})
    swe = lambda text, repo="o/Project": matching.record(1, {"repo": repo, "patch": PATCH.format(1, 2), "problem_statement": text})
    shared = lambda b: set(matching.block_keys(sec)) & set(matching.block_keys(b))
    assert shared(swe("Fuzzing found a bug in hashBatch. More.")) and shared(swe("A title.\n\n" + "word " * 200 + "see helper_fn_5 there"))
    assert not shared(swe("Fuzzing found a bug in hashBatch.", "o/other")) and not shared(swe("Fuzzing found a bug in hashPatch."))
    top = matching.record(0, {"instance_id": "libproject.ossfuzz-1", "patch": None, "sanitizer_report": report.replace("helper_fn_0", "Dap::RemoteBatch::hashBatch")})
    got = dict(zip(matching.FEATURES, matching.features(top, swe("Fuzzing found a bug in hashBatch. More."))))
    assert got["function_first"] == got["said"] == 1.0
    other = dict(zip(matching.FEATURES, matching.features(top, swe("Xyz::OtherBatch::hashBatch crashes."))))
    assert other["function_first"] == other["said"] == 0.0


def test_every_verbatim_window_is_a_leak(spark, sf_dir):
    """Fifteen words in a row of which four are own ones, alone or with an equal word of the item before and behind, by their places alone."""
    known = leaks.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect()])
    windows = refused = 0
    for i, ids in known.ids.items():
        own = known.own[i]
        for s in range(0, len(ids) - 14, 5):
            if own[s : s + 15].sum() >= 4:
                for doc in (ids[s : s + 15], np.concatenate([ids[s + 7 : s + 8], [-1] * 6, ids[s : s + 15], [-1] * 6, ids[s + 3 : s + 4]]).astype(np.int32)):
                    windows, refused = windows + 1, refused + (leaks.leaked(ids, own, doc) < 15)
    assert windows > 100 and refused == 0
    assert leaks.diagonals(np.array([1, -1, 2]), np.array([5, 1, -1, 2, 1]), 2)[0][0].tolist() == [0, 2] and leaks.diagonals(ids[:0], ids, 1) == []


def test_latent_space_is_fitted_on_both_sides(spark):
    """Words of two items that documents always hold together are a main direction, though no item's passage has both."""
    known = leaks.Items([(i, ITEM.format(i + 10)) for i in range(12)])
    a, b = known.number["reader_10"], known.number["union_15"]
    docs = spark.createDataFrame([(d, np.array([a, -1, b], np.int32).tobytes()) for d in range(200)], "doc_id long, ids binary")
    part = next(known.parts())
    assert (part.words == np.arange(len(known.number))).all()
    basis = leaks.latent(docs, part, np.ones(len(known.number), np.float32), rank=4, total=200)
    both = np.zeros(len(basis))
    both[[a, b]] = 0.5**0.5
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3) and np.linalg.norm(basis.T @ both) > 0.9


def test_passages_times_matrices():
    """Products with the sparse passages are those with the matrix that they stand for."""
    rng = np.random.default_rng(2)
    rows, weight = leaks.distinct(rng.integers(-1, 30, (40, 10)).astype(np.int32)), rng.random(30).astype(np.float32)
    a = np.zeros((40, 30), np.float32)
    for k, row in enumerate(rows):
        a[k, row[row >= 0]] = weight[row[row >= 0]]
    x, y, out = rng.random((30, 4)), rng.random((40, 4)), np.ones((30, 4))
    leaks.transposed(rows, weight, y, out)
    assert np.allclose(leaks.times(rows, weight, x), a @ x, atol=1e-4) and np.allclose(out, 1 + a.T @ y, atol=1e-4)
