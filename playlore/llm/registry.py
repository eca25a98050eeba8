"""The queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playlore.llm import centroids, fingerprints, golay, htmltext, langid, licenses, linededup, merkle, mixing, neardup, packing, quality, sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_linededup": linededup.op1_linededup,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_licenses": licenses.op3_licenses,
        "op4_sharding": sharding.op4_sharding,
        "op5_packing": packing.op5_packing,
        "op6_quality": quality.op6_quality,
        "op7_htmltext": htmltext.op7_htmltext,
        "op8_langid": langid.op8_langid,
        "op9_mixing": mixing.op9_mixing,
        "op10_neardup": neardup.op10_neardup,
        "op11_simhash": golay.op11_simhash,
        "op12_centroids": centroids.op12_centroids,
        "op13_manifest": merkle.op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_linededup": linededup.ORACLE, "op2_fingerprints": fingerprints.ORACLE, "op3_licenses": licenses.ORACLE, "op4_sharding": sharding.ORACLE, "op6_quality": quality.ORACLE, "op9_mixing": mixing.ORACLE, "op10_neardup": neardup.ORACLE, "op12_centroids": centroids.ORACLE, "op13_manifest": merkle.ORACLE}
