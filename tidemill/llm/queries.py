"""The queries of this package and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import op9_ann
from .binary import op6_binary
from .html import op5_html
from .langid import op2_langid
from .oracles import QUALITY, WARC
from .packing import op10_packing
from .quality import op7_quality
from .sentencepiece import op1_sentencepiece
from .sharding import op3_sharding
from .simhash import op8_simhash
from .warc import op4_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_langid": op2_langid,
        "op3_sharding": op3_sharding,
        "op4_warc": op4_warc,
        "op5_html": op5_html,
        "op6_binary": op6_binary,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_ann": op9_ann,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": WARC, "op7_quality": QUALITY}
