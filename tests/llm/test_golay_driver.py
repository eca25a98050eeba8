from playlore.llm import components, golay


def test_no_step_of_op11_is_broadcast(spark, monkeypatch):
    plans = []

    def watched(stash):
        def kept(df, name):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return stash(df, name)

        return kept

    for module in (components, golay):
        monkeypatch.setattr(module, "stash", watched(module.stash))
    rows = [(i, f"one two three four five six {'seven' if i % 3 else 'eight'} {i // 4}") for i in range(40)] + [(99, None)]
    found = golay.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=3)
    assert found.count() == 41
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert plans and not any("Broadcast" in p for p in plans)
