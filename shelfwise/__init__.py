"""Product-catalog classification as Spark jobs.

Every operator takes and returns a DataFrame (or a Column), holds no session of
its own, and leaves the physical plan to Catalyst and AQE.
"""
