"""spark-submit entry of the batch job; see trailpack.plans.job."""

import sys

from trailpack.plans.job import main

if __name__ == "__main__":
    sys.exit(main())
