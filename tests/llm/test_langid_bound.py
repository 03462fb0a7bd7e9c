"""A column that holds no languages is an error, not a full driver."""

import pytest

from veritab.llm import langid


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES_MOST", 3)
    rows = spark.createDataFrame([(k, "some text", f"lang{k}") for k in range(0, 40)], "doc_id long, text string, lang string")
    with pytest.raises(Exception, match="more than 3 languages"):
        langid.fit_languages(rows.coalesce(1))
    assert len(langid.fit_languages(rows.where("doc_id < 3")).languages) <= 3
