"""Panel analytics on Spark DataFrames.

``functions`` holds column expressions, ``operators`` DataFrame-to-DataFrame
operations and model fits, ``sources`` readers and writers, and ``plans`` the
reports and studies composed from them.
"""
