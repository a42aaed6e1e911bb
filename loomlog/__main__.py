import sys

from loomlog.cli import main

sys.exit(main())
