"""``python -m refloom``."""

from __future__ import annotations

import sys

from refloom.cli import main

sys.exit(main())
