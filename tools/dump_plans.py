"""Write the formatted physical plan of queries to docs/plans/<name>.txt.

usage: python tools/dump_plans.py sf_dir name [name ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main():
    from cohortlab.plans.queries import QUERIES
    from cohortlab.session import get_spark
    spark = get_spark(master="local[8]", shuffle_partitions=16)
    sf = sys.argv[1]
    for name in sys.argv[2:]:
        df = QUERIES[name](spark, sf)
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        # drop machine-specific paths
        text = text.replace(os.path.abspath(sf), "<sf_dir>")
        with open(os.path.join(ROOT, "docs", "plans", f"{name}.txt"), "w") as f:
            f.write(text)
        print(name, len(text))


if __name__ == "__main__":
    main()
