"""Text functions that run for every word or line: without regular expressions where a plain search does, same results as with them."""

import re
import sys

from pyspark.sql import functions as F

from quern.functions import text as T


def test_plain_searches_equal_regular_expressions(spark):
    assert set(T.SPACES) == {chr(i) for i in range(sys.maxunicode + 1) if re.match(f"[{T.SPACE}]", chr(i), re.ASCII)}
    odd = [None, "", " ", "\r\n", "a\r\n", "\u0085 a\u2028b \u3000", "a\x00", " x1 y_Z \u0645\u0646\u062d %", "\u0631\u0633\u0648\u0645 Fees url", "\u0633\u0627\u0639\u0629 \u0645\u0639\u062a\u0645\u062f\u0629. a+b"]
    rows, c, gap = spark.createDataFrame([(x,) for x in odd] + [(f"{x}a{x}{x}b c{x}",) for x in T.SPACES], "text string"), F.col("text"), f"[{T.SPACE}]+"
    low = F.lower(T.fold_alef(c))
    pairs = [
        (T.strip(c), F.regexp_replace(c, f"^{gap}|{gap}$", "")), (T.words(c), F.filter(F.split(c, gap), lambda w: w != "")), (T.n_matches(c, T.ARABIC), F.length(c) - F.length(F.regexp_replace(c, f"[{T.ARABIC}]", ""))),
        *((T.occurs(low, p), low.rlike(p)) for p in ("url", "\u0631\u0633\u0648\u0645", "\u0633\u0627\u0639\u0629 \u0645\u0639\u062a\u0645\u062f\u0629", "a.b", "x|y")),
    ]
    for plain, regular in pairs:
        assert rows.where(~plain.eqNullSafe(regular)).count() == 0
    plans = rows.select(T.strip(c), T.words(c), T.section(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plans and "RLIKE" not in plans and "[" not in plans.split("split(")[1].split(")")[0].split(",")[-2]
