import sys

from tamarack.commands import main

sys.exit(main())
