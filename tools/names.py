"""Print the registered query names of catalogue modules: python tools/names.py [module ...]."""

import re
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1] / "tempora" / "catalog"
for module in sys.argv[1:]:
    text = (ROOT / f"{module}.py").read_text()
    print(" ".join(re.findall(r'@query\(\s*"(\w+)"', text)))
