"""``draftlake-analyse FILE...`` or ``python -m draftlake FILE...``: name.json and name.md beside each drawing; a FILE may be a glob."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from .plans.analysis import analyse_path
from .plans.documents import write_documents
from .plans.store import Keeper

logger = logging.getLogger(__name__)


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if not args:
        print("Usage: draftlake-analyse <path-to-dxf>...")
        return 1
    spark = SparkSession.builder.appName("draftlake").getOrCreate()
    for path in args:
        logger.info("Analysis of %s", path)
        with Keeper(spark) as keep:
            for name in write_documents(analyse_path(spark, path, keep=keep)):
                logger.info("Written: %s", name)
    return 0


if __name__ == "__main__":
    sys.exit(main())
