import sys

from claimstead.cli import main

sys.exit(main())
