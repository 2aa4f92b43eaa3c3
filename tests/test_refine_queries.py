"""The refinement queries follow the published variant to its own end."""

from terrane.plans import regimes


def test_refinements_end_by_their_stopping_rule(spark):
    stops = {r.stop for r in regimes.refine_history(spark, "/root/testdata/sf0.001").collect()}
    assert stops == {"no_label_changes"}
    ends = regimes.lambda_sensitivity(spark, "/root/testdata/sf0.001").collect()
    assert len(ends) == 9 and all(r.stop != "max_iterations" for r in ends)
