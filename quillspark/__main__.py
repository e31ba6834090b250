"""Run as a module."""

from .cli import main

raise SystemExit(main())
