"""Copies of a notice that follow each other closely."""

import pytest

from tidemark.llm import license

MIT = "Released under the MIT License."
RIGHTS = "All rights reserved."


@pytest.mark.parametrize("notice", [MIT, RIGHTS])
@pytest.mark.parametrize("between", [" ", "\n", " and then also "])
def test_close_repeats_are_all_found(spark, notice, between):
    text = f"x {between.join([notice] * 4)} y"
    rows = license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    starts = [i for i in range(len(text)) if text.startswith(notice, i)]
    assert sorted((r.start, text[r.start : r.end], r.coverage) for r in rows) == [(i, notice[:-1], 1.0) for i in starts]
