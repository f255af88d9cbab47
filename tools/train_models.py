"""Train the demand model of table folders and save it, so that queries only load it.

    python tools/train_models.py FOLDER...

``spark.checkpoint.dir`` names the folder that keeps models; a model is found again as long as the day rows are the same.
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from branchlight.plans import q_forecast  # noqa: E402
from branchlight.session import build_session  # noqa: E402


def main() -> None:
    spark = build_session(app="branchlight-train")
    for folder in sys.argv[1:]:
        model, path = q_forecast.train_model(spark, folder)
        print(folder, path, model.metrics)


if __name__ == "__main__":
    main()
