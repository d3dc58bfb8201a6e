"""``python -m claimveil pipeline|attack|method FOLDER [MEMBERS]``: runs a job and prints its tables."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from claimveil.plans import attack, method, pipeline


def main(job: str, out: str, members: str = "8000") -> None:
    spark = SparkSession.builder.appName(f"claimveil {job}").getOrCreate()
    if job == "method":
        print(method.main(spark, out))
    else:
        plan = {"pipeline": pipeline, "attack": attack}[job]
        print(plan.report(plan.main(spark, out, int(members))))


if __name__ == "__main__":
    main(*sys.argv[1:])
