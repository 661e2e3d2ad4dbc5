"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import changepoints, chat, decontam, langid, media, packing, parity_join, quality, runs, secrets, spm, toxicity, urlfilter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": lambda s, d: langid.op1_langid(table(s, d, "documents")),
        "op2_toxicity": lambda s, d: toxicity.op2_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op3_quality": lambda s, d: quality.op3_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op4_chat": lambda s, d: chat.op4_chat(table(s, d, "conversations")),
        "op5_urlfilter": lambda s, d: urlfilter.op5_urlfilter(table(s, d, "pages")),
        "op6_decontam": lambda s, d: decontam.op6_decontam(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_secrets": lambda s, d: secrets.op7_secrets(table(s, d, "documents")),
        "op8_spm": lambda s, d: spm.op8_spm(table(s, d, "documents")),
        "op9_media": lambda s, d: media.op9_media(table(s, d, "documents")),
        "op10_parity_join": lambda s, d: parity_join.op10_parity_join(table(s, d, "documents")),
        "op11_changepoints": lambda s, d: changepoints.op11_changepoints(table(s, d, "sale_lines")),
        "op12_runs": lambda s, d: runs.op12_runs(table(s, d, "documents")),
        "op13_packing": lambda s, d: packing.op13_packing(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": chat.OP4_SQL, "op5_urlfilter": urlfilter.op5_sql(), "op7_secrets": secrets.OP7_SQL, "op11_changepoints": changepoints.OP11_SQL}
