import sys

from tarnfall.cli import main

sys.exit(main())
