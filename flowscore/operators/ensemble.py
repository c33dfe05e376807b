"""Voting ensemble over fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import (
    HasLabelCol,
    HasPredictionCol,
    HasProbabilityCol,
    HasRawPredictionCol,
)
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame

from flowscore.functions import votes as V
from flowscore.functions.names import quote_all
from flowscore.operators.scoring import class_count, model_columns, predict_each

# The voting modes.
MODES = ("majority", "attack", "normal")


class VotingEnsemble(
    Transformer,
    HasLabelCol,
    HasPredictionCol,
    HasRawPredictionCol,
    HasProbabilityCol,
    MLReadable,
    MLWritable,
):
    """Adds the members' votes, their counts and shares per class, and a verdict.

    ``majority``: the class with most votes, the lowest class on a tie.
    ``attack``: 1 as soon as one member says 1.
    ``normal``: 1 only if no member says 0.

    Counts (``rawPredictionCol``) and shares (``probabilityCol``) hold the plain
    votes in every mode, so in the last two their largest element may belong to
    another class than the verdict. Both are ``array<double>``; see
    ``metrics.as_vector`` for MLlib evaluators.
    """

    mode = Param(
        Params._dummy(), "mode", "voting mode: " + ", ".join(MODES), TypeConverters.toString
    )
    predictionsCol = Param(
        Params._dummy(), "predictionsCol", "array of the members' votes", TypeConverters.toString
    )
    numClasses = Param(Params._dummy(), "numClasses", "number of classes", TypeConverters.toInt)

    def __init__(
        self,
        models: Sequence[Transformer] | None = None,
        predictionCol: str = "ensemble_prediction",
        predictionsCol: str = "predictions",
        rawPredictionCol: str = "rawPrediction",
        probabilityCol: str = "probability",
        mode: str | None = None,
        labelCol: str | None = None,
        numClasses: int | None = None,
    ):
        super().__init__()
        self.models = list(models or [])
        self._setDefault(mode="majority")
        chosen = {
            "predictionCol": predictionCol,
            "predictionsCol": predictionsCol,
            "rawPredictionCol": rawPredictionCol,
            "probabilityCol": probabilityCol,
            "mode": mode,
            "labelCol": labelCol,
            "numClasses": numClasses,
        }
        if self.models:
            first = self.models[0]
            chosen["labelCol"] = labelCol or model_columns(first).label
            chosen["numClasses"] = numClasses or class_count(first)
        if mode is not None and mode not in MODES:
            raise ValueError(f"mode {mode!r} is not one of {MODES}")
        self._set(**{name: value for name, value in chosen.items() if value is not None})

    def getMode(self) -> str:
        return self.getOrDefault(self.mode)

    def getPredictionsCol(self) -> str:
        return self.getOrDefault(self.predictionsCol)

    def getNumClasses(self) -> int:
        if not self.isDefined(self.numClasses):
            raise ValueError("the first member has no numClasses; pass numClasses")
        return self.getOrDefault(self.numClasses)

    def fit(self, dataset: DataFrame, params=None) -> VotingEnsemble:
        """Members are fitted already; lets the ensemble stand in for an estimator."""
        return self.copy(params) if params else self

    def verdict(self, ballots: list[str]) -> Column:
        """The ensemble's prediction from its members' prediction columns, in their order."""
        mode = self.getMode()
        if mode == "attack":
            return V.attack_vote(ballots)
        if mode == "normal":
            return V.normal_vote(ballots)
        if mode == "majority":
            return V.majority_vote(ballots, self.getNumClasses())
        raise ValueError(f"mode {mode!r} is not one of {MODES}")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if not self.models:
            raise ValueError("an ensemble needs at least one model")
        added = {
            self.getPredictionsCol(): V.ballot,
            self.getRawPredictionCol(): lambda b: V.vote_counts(b, self.getNumClasses()),
            self.getProbabilityCol(): lambda b: V.vote_shares(b, self.getNumClasses()),
            self.getPredictionCol(): self.verdict,
        }
        clash = sorted(set(added).intersection(dataset.columns))
        if clash:
            raise ValueError(f"input columns {clash} are also outputs of the ensemble")
        scored, ballots, _ = predict_each(dataset, self.models, [None] * len(self.models))
        return scored.select(
            *quote_all(dataset.columns),
            *[make(ballots).alias(name) for name, make in added.items()],
        )

    def write(self) -> MLWriter:
        return _EnsembleWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EnsembleReader()


def _member_path(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/members/{number:04d}"


class _EnsembleWriter(MLWriter):
    """Params as metadata, members as saved models below ``members/``."""

    def __init__(self, ensemble: VotingEnsemble):
        super().__init__()
        self.ensemble = ensemble

    def saveImpl(self, path: str) -> None:
        members = self.ensemble.models
        DefaultParamsWriter.saveMetadata(
            self.ensemble, path, self.sparkSession, extraMetadata={"members": len(members)}
        )
        for number, member in enumerate(members):
            member.write().save(_member_path(path, number))


class _EnsembleReader(MLReader):
    def load(self, path: str) -> VotingEnsemble:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        members = [
            DefaultParamsReader.loadParamsInstance(_member_path(path, number), self.sparkSession)
            for number in range(metadata["members"])
        ]
        ensemble = VotingEnsemble(members)
        ensemble._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(ensemble, metadata)
        return ensemble
