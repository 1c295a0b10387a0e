"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from answerloom.registry import REGISTRY  # noqa: E402
from answerloom.session import build_session  # noqa: E402
from answerloom.sources.tables import SPREAD_KEY  # noqa: E402

HEADLINE = (
    "page_text",
    "document_sentences",
    "document_chunks",
    "embed_documents",
    "topk_vectors",
    "topk_chunks",
    "topk_ann",
    "topk_pruned",
    "index_sync_actions",
    "personal_data",
    "topic_verdicts",
    "grounded_sentences",
    "checked_answers",
    "next_steps",
    "guarded_conversations",
    "four_way_routing",
    "orders_for_region",
    "accounts_per_nation",
    "evaluated_questions",
    "answer_questions",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        int(cpus),
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            SPREAD_KEY: cpus,  # the tables are files of one row group
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    REGISTRY["accounts_per_nation"].run(spark, directory).collect()  # start the JVM's work
    spent: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            REGISTRY[name].run(spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        spent[name] = round(min(runs), 3)
        print(f"{name} {spent[name]}", file=sys.stderr, flush=True)
    scale = Path(directory).name.removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
