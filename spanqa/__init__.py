"""spanqa: span-based multilingual QA data processing on Spark DataFrames.

Four batch jobs, all expressed as DataFrame / SQL operations:

* ``plans.evaluate``  - score predictions against N-way annotations
* ``plans.prepare``   - articles -> byte-offset-tracked wordpiece windows
* ``plans.predict``   - per-window model scores -> one answer per question
* ``plans.goldp``     - gold-passage split by language and SQuAD-style scoring
"""

__version__ = "0.1.0"
