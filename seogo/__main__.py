"""python -m seogo"""

from .cli import main

raise SystemExit(main())
