"""The neighbours of a landing are read from its texts once, however often the links look at them."""

from compare import SF

from snapfold.operators import landing
from snapfold.plans import landing_queries


def test_links_do_not_read_texts_again(spark, monkeypatch):
    plans, put = {}, landing.Scratch.put
    monkeypatch.setattr(landing.Scratch, "put", lambda self, df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), put(self, df, name))[1])
    assert landing_queries.landed_links(spark, SF).count() > 0
    assert "links" in plans and "raw_output" not in plans["links"]
