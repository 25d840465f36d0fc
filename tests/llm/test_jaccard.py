import random

from courierworks.llm import components, jaccard
from courierworks.llm.components import connected
from tests.llm.cases import changed, frame, odd_texts, words


def sets(text):
    parts = [w for w in (text or "").encode().split()]
    return {tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def plain(texts, ids=None, similarity=0.8):
    ids = list(range(len(texts))) if ids is None else ids
    have = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if have[i] and len(have[i] & have[j]) >= similarity * len(have[i] | have[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {ids[i]: (ids[find(i)], links[i], len(have[i])) for i in range(len(texts))}


def rows(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_shingles) for r in df.collect()}


def test_classes_and_links_equal_all_pairs(spark):
    texts = odd_texts() + [changed(words(300, k % 4), 40 + k) for k in range(30)] + [words(6, 900), words(6, 900) + " z"]
    assert rows(jaccard.join_documents(frame(spark, texts))) == plain(texts)


def test_dense_group_in_blocks_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "SMALL", 6)
    base = words(150, 77)
    texts = [changed(base, 60 + k) for k in range(40)] + [base] * 5 + [words(100, 1000 + k) + " " + words(30, 5) for k in range(40)]
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (jaccard.LEVELS, 6))
    assert rows(jaccard.join_documents(frame(spark, texts, clash=False))) == plain(texts)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(50)}}


def test_null_ids_empty_tables_and_the_kept_ones(spark):
    base = words(80, 3)
    docs = frame(spark, [base, base, base, None, ""], [None, 5, 3, 9, 10])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join_documents(docs).collect()}
    assert got == {None: (None, 0), 5: (3, 1), 3: (3, 1), 9: (9, 0), 10: (10, 0)}
    kept = jaccard.one_per_class(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, 3, 9, 10}
    assert jaccard.join_documents(frame(spark, [])).count() == 0


def test_pairs_whose_shared_passages_are_all_hot(spark, monkeypatch):
    """Every shingle of a pair is in about 10 or 100 other documents, so all of its buckets are large and each is split on its own sample."""
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (jaccard.LEVELS, 6))
    rng = random.Random(11)
    passage = {(s, v): words(50, 5000 + 10 * s + v) for s in range(20) for v in range(10)}
    texts = []
    for _ in range(600):
        picks = [rng.randrange(10) for _ in range(20)]
        near = picks[:18] + [(v + rng.randrange(1, 10)) % 10 for v in picks[18:]]
        texts += [" ".join(passage[s, v] for s, v in enumerate(p)) for p in (picks, near)]
    have = [sets(t) for t in texts]
    assert all(len(have[i] & have[i + 1]) >= 0.8 * len(have[i] | have[i + 1]) for i in range(0, len(texts), 2))
    got = rows(jaccard.join_documents(frame(spark, texts, clash=False)))
    lost = [i for i in range(0, len(texts), 2) if got[i][0] != got[i + 1][0] or not got[i][1]]
    assert lost == []


def test_open_sets_have_as_many_rows_as_paths(spark, monkeypatch):
    """Sets that share a long passage stay open in many large buckets; a further split must not multiply those rows by its paths."""
    most = []

    def watched(large, sets, similarity, plain=jaccard.pivoted):
        most.append(max(r["count"] for r in large.groupBy("id").count().collect()))
        return plain(large, sets, similarity)

    monkeypatch.setattr(jaccard, "pivoted", watched)
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (jaccard.LEVELS, 6))
    own = [words(60, 3000 + k) for k in range(90)]
    texts = [words(60, 8) + " " + o for o in own] + [words(60, 8) + " " + changed(own[k], 5) for k in range(3)]
    assert rows(jaccard.join_documents(frame(spark, texts, clash=False))) == plain(texts)
    assert len(most) == 3 and most[1] <= 7 and most[2] <= 15


def test_stars_need_no_round_and_others_one_less(spark, monkeypatch):
    """Every written table costs a shuffle's worth of tasks: edges that are stars are the result, without a round that proves it."""
    written = []
    monkeypatch.setattr(components, "stage", lambda df, plain=components.stage: written.append(1) or plain(df))
    stars = [(100, 100 + k) for k in range(1, 50)] + [(1, 9), (9, 1), (7, 7), (None, 3)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {**{100 + k: 100 for k in range(50)}, 1: 1, 9: 1} and len(written) == 1
    written.clear()
    got = {r.node: r.root for r in connected(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} and len(written) == 2


def test_small_buckets_of_all_splits_meet_in_one_join(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard, "tied", lambda *a, plain=jaccard.tied: calls.append(1) or plain(*a))
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (jaccard.LEVELS, 6))
    texts = [words(60, 8) + " " + words(60, 3000 + k) for k in range(60)] + [words(60, 8) + " " + changed(words(60, 3000 + k), 5) for k in range(3)]
    for few in (jaccard.FEW_PIVOTS, 0):  # pivots broadcast and joined
        monkeypatch.setattr(jaccard, "FEW_PIVOTS", few)
        calls.clear()
        assert rows(jaccard.join_documents(frame(spark, texts, clash=False))) == plain(texts)
        assert len(calls) == 1


def exploded(df):
    """Rows that the explodes of a plan made when it ran."""
    df.collect()
    nodes, made = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        at = nodes.pop()
        if "AdaptiveSparkPlan" in at.nodeName() or "QueryStage" in at.nodeName():
            nodes.append(at.executedPlan() if "AdaptiveSparkPlan" in at.nodeName() else at.plan())
        if at.nodeName() == "Generate":
            made += at.metrics().apply("numOutputRows").value()
        nodes += [at.children().apply(i) for i in range(at.children().size())]
    return made


def test_pivots_are_named_once_a_bucket(spark, monkeypatch):
    """What is exploded to name the pivots of large buckets follows the number of buckets, whatever number of members each has."""
    seen = []

    def watched(large, sets, similarity, plain=jaccard.pivoted):
        calls = []
        monkeypatch.setattr(jaccard, "gathered", lambda df, n: calls.append(df) or plain_gathered(df, n))
        out = plain(large, sets, similarity)
        monkeypatch.setattr(jaccard, "gathered", plain_gathered)
        members, buckets = large.count(), large.select("key").distinct().count()
        assert {r.pivot for r in calls[0].collect()} == {p for r in large.select("pivots").collect() for p in r.pivots}
        seen.append((members, buckets, exploded(calls[0])))
        return out

    plain_gathered = jaccard.gathered
    monkeypatch.setattr(jaccard, "pivoted", watched)
    monkeypatch.setattr(jaccard.candidates, "__defaults__", (jaccard.LEVELS, 6))
    texts = [changed(words(150, 77), 60 + k) for k in range(40)]
    assert rows(jaccard.join_documents(frame(spark, texts, clash=False))) == plain(texts)
    assert seen and all(0 < made <= jaccard.PIVOTS * buckets < members for members, buckets, made in seen)
