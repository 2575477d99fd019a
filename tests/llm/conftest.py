import os
import sys
from pathlib import Path

# Workers import the operators' modules too.
os.environ["PYTHONPATH"] = os.pathsep.join([str(Path(__file__).resolve().parents[2]), os.environ.get("PYTHONPATH", "")])
sys.path.insert(0, str(Path(__file__).resolve().parent))
