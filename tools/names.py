"""Names of a module's queries: python tools/names.py tessitura.plans.general"""

import importlib
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
print(*importlib.import_module(sys.argv[1]).QUERIES)
