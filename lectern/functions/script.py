"""Script conversion (simplified to Taiwan traditional), pluggable.

With OpenCC installed its s2twp profile is used. Without it a caller may pass a phrase table, applied by
longest match; that is a stand-in for tests and small vocabularies, not the same conversion. Without either
the text is left as it is.
"""

from __future__ import annotations

import importlib.util
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A few phrases and characters for examples and tests.
SMALL_TABLE = {"软件": "軟體", "软": "軟", "国": "國", "华": "華", "简": "簡", "体": "體", "记": "記", "笔": "筆", "与": "與", "处": "處", "财": "財", "产": "產", "标": "標", "准": "準", "强": "強", "动": "動"}


def available() -> bool:
    return importlib.util.find_spec("opencc") is not None


def to_traditional(text: Column, table: dict[str, str] | None = None) -> Column:
    """Converted text; see the module for what converts it."""
    if not available() and not table:
        return text

    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if available():
            import opencc

            one = opencc.OpenCC("s2twp").convert
        else:
            found = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))
            one = lambda s: found.sub(lambda m: table[m[0]], s)
        for s in batches:
            yield s.map(one, na_action="ignore")

    return convert(text)
