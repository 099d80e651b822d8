"""Queries give all rows of the reference's result, not only those that an older query beside them has."""

from ledgerlight.plans import registry

D = "/root/testdata/sf0.01"


def test_all_cells_of_the_cohort_matrix(spark):
    cells = [tuple(r) for r in registry.queries()["cohort_matrix_cells"](spark, D).collect()]
    rates = {(r["cohort_month"], r["cohort_index"]): r["retention_rate"] * 100 for r in registry.cohort_retention(spark, D).collect()}
    assert {(m, i): p for m, i, p in cells} == rates and len(cells) == len(rates)
    print("cells", len(cells), min(i for _, i, _ in cells), max(i for _, i, _ in cells), "of 0 to 12:", sum(0 <= i <= 12 for _, i, _ in cells))
    assert min(i for _, i, _ in cells) < 0 and max(i for _, i, _ in cells) > 12


def test_the_board_is_ordered_by_score(spark):
    q = registry.queries()
    rows = sorted(q["recommendations"](spark, D).collect(), key=lambda r: (-r["strategic_score"], r["customer_id"]))
    board = [r["customer_id"] for r in q["action_board_by_score"](spark, D).collect()]
    assert board == [r["customer_id"] for r in rows[:120]]
    print("in both boards", len({*board} & {r["customer_id"] for r in q["action_board"](spark, D).collect()}))


def test_registered_models_have_the_reference_s_folds_and_depth(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(registry.ml, "train", lambda f, name, target, folds: asked.append(folds))
    monkeypatch.setattr(registry, "metrics_table", lambda s, trained: trained)
    registry.queries()["model_metrics"](spark, D)
    assert asked == [5, 5] and registry.ml.churn_pipeline().getStages()[-1].getMaxDepth() == 30
