"""Analytics over large ensembles of stratified epidemic-model output, on Spark."""
