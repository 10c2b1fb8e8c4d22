import pandas as pd

from paths import SF
from tarmac.operators import windows as W
from tarmac.sources.fixtures import flights


def test_rolling_global_matches_bruteforce(spark):
    f = flights(spark, SF)
    got = W.rolling_delay(f, buckets=7).select("Flight_ID", "Rolling_Delay_Mean", "Rolling_Delay_Std").toPandas().set_index("Flight_ID")
    p = f.select("Flight_ID", "Scheduled_Time", "Delay_Minutes").toPandas().sort_values(["Scheduled_Time", "Flight_ID"])
    p["m"] = p["Delay_Minutes"].rolling(5, min_periods=1).mean()
    p["s"] = p["Delay_Minutes"].rolling(5, min_periods=1).std().fillna(0)
    p = p.set_index("Flight_ID")
    assert (abs(got.loc[p.index, "Rolling_Delay_Mean"] - p["m"]) < 1e-9).all()
    assert (abs(got.loc[p.index, "Rolling_Delay_Std"] - p["s"]) < 1e-9).all()


def test_last_hour_load_matches_bruteforce(spark):
    f = flights(spark, SF)
    got = {r.Flight_ID: r.Recent_Flights for r in W.last_hour_load(f).collect()}
    p = f.select("Flight_ID", "Origin", "Runway", "Date", "Scheduled_Time").toPandas()
    for _, r in p.sample(50, random_state=1).iterrows():
        g = p[(p.Origin == r.Origin) & (p.Runway == r.Runway) & (p.Date == r.Date)]
        n = ((g.Scheduled_Time >= r.Scheduled_Time - pd.Timedelta(hours=1)) & (g.Scheduled_Time <= r.Scheduled_Time)).sum()
        assert got[r.Flight_ID] == n

