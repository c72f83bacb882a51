"""recordchecks: check and reshape records at scale with Spark DataFrames.

Every operator takes DataFrames and returns DataFrames, keeps its rules as
data, and uses built-in Spark expressions (no Python UDF in any hot path;
HL7 XML is made and read by Arrow kernels over batches).  Sub-packages:

* ``sources``   - table readers, CSV/JSON/text sources, sinks, and the
                  bindings that derive operator inputs from the driver tables
* ``functions`` - column-expression helpers (HL7 field access, JSON paths,
                  blank tests, timestamp tests)
* ``operators`` - the operators themselves, one module per capability
* ``rules``     - fixed rule tables (code sets, required fields, texts)
* ``plans``     - the registered queries and their SQL oracles
* ``streaming`` - the stateless checks wired to Structured Streaming
"""

__version__ = "0.1.0"
