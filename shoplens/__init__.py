"""shoplens: commerce analytics and recommendations as Spark DataFrame jobs.

Every public function takes DataFrames (or a session plus a table folder) and
returns a DataFrame; nothing is collected to the driver.
"""

__version__ = "0.1.0"
