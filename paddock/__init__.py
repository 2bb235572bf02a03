"""Sports-forecasting analytics on Spark.

Every public function takes and returns DataFrames and works on all sources,
seasons and rounds at once; nothing is looped round by round on the driver.
"""
