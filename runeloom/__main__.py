import sys

from runeloom.cli import main

sys.exit(main())
