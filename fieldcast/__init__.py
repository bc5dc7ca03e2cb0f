"""fieldcast: reliability forecasting for installed machine fleets, on Spark.

The package is organised the way the data flows:

* ``sources``    extracts, workbooks, posterior-draw files and the stored products
* ``functions``  column expressions (dates, text, counter noise, recursions)
* ``operators``  DataFrame -> DataFrame building blocks
* ``plans``      end-to-end jobs composed from the operators
* ``streaming``  the incremental twin of the interval monitor
"""

__version__ = "0.1.0"
