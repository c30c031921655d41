import importlib.util
import os
import sys

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

# This module takes the name of the one above it: what the tests there import from it is here as well.
_spec = importlib.util.spec_from_file_location("conftest_above", os.path.join(os.path.dirname(HERE), "conftest.py"))
_above = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_above)
rows = _above.rows
