import sys

from .cli import build_parser, run
from .session import session

build_parser().parse_args(sys.argv[1:])  # mistakes show before a session starts
sys.exit(run(session("stratakeep"), sys.argv[1:]))
