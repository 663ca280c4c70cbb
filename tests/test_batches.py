import pyarrow as pa

from opinara.operators import features as X
from opinara.operators import terms as V
from opinara.operators.batches import in_slices, slices
from opinara.operators.lemma import _replaced, _split


def test_slices_hold_bounded_bytes():
    texts = pa.array(["cards a", None, "", "x" * 50, "cards"] * 20)
    parts = list(slices(texts, 60))
    assert pa.concat_arrays(parts) == texts and len(parts) > 10
    assert all(sum(len(t or "") for t in p.to_pylist()) <= 60 or len(p) == 1 for p in parts)
    assert [len(p) for p in slices(pa.array([], pa.string()))] == [0]
    lists = _split(pa.array(["cards a", "", "b cards"] * 9))
    table = (pa.array(["cards"]), pa.array(["card"]))
    assert pa.concat_arrays([_replaced(p, table) for p in slices(lists, 40)]).to_pylist() == _replaced(lists, table).to_pylist()
    assert in_slices(lambda t: t)(texts) == texts


def test_cleaning_leaves_nothing_behind():
    """The words of a layout go with it, without a run of the cycle collector."""
    import gc
    import weakref

    from opinara.operators import dictionary as D

    class Watched(D.defaultdict):
        pass

    made = []

    def watched(*args):
        made.append(weakref.ref(d := Watched(*args)))
        return d

    kept, D.defaultdict = D.defaultdict, watched
    gc.disable()
    try:
        assert D.Cleaner()(pa.array(["good cards", None, "not good"])).to_pylist()[0]["cleaned"] == "good cards"
        assert len(made) == 2 and all(ref() is None for ref in made)
    finally:
        D.defaultdict = kept
        gc.enable()


def test_counts_are_let_go_before_they_are_named(monkeypatch):
    monkeypatch.setattr(V, "_NAMED", 2, raising=False)
    counts = V._Counts()
    counts.add(pa.array(["good cards", "good cards good", "", "a!b cards"]))
    shipped = counts.ship()
    parts = [next(shipped)]
    assert not counts.parts and not counts.words
    parts += shipped
    assert all(p.num_rows <= 2 for p in parts)
    rows = sorted(tuple(r.values()) for p in parts for r in p.to_pylist())
    assert rows == [("cards", 3, 3), ("cards good", 1, 1), ("good", 3, 2), ("good cards", 2, 2)]


def test_weights_leave_a_task_a_few_texts_at_a_time(spark, capsys):
    """Long rows, not one list for each text of a whole batch; equal to the relational form."""
    texts = [("a", "good cards good"), (None, "cards bad"), ("b", None), ("a", "good cards good"), ("c", "new words")]
    docs = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "review_id long, kind string, cleaned_text string")
    vocabulary = spark.createDataFrame([("good", 1.5), ("cards", 1.0), ("good cards", 2.0), ("bad", 3.0)], "term string, idf double")
    weights = X.tfidf_weights(docs, vocabulary, keep=["kind"])
    weights.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "Generate" not in plan
    wanted = X.joined_weights(X.document_terms(docs, keep=["kind"]), vocabulary, keep=["kind"])
    rounded = [sorted(((i, str(k), t, round(w, 9)) for i, k, t, w in d.collect())) for d in (weights, wanted)]
    assert rounded[0] == rounded[1] and len(rounded[0]) == 8 and weights.columns == wanted.columns
